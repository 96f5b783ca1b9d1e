"""Registered queries. Importing a module here adds its queries to the registry."""

from importlib import import_module

MODULES = ("stats", "segments", "windows", "filters", "geometry", "calibration", "names", "tables", "reports", "sampling", "streams")


def load_all():
    from pathweave.plans.registry import REGISTRY

    for name in MODULES:
        import_module(f"pathweave.plans.{name}")
    return REGISTRY
