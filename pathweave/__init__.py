"""Trajectory analytics on Spark: tracks, steps, segments, calibration and reports as DataFrames."""

from pathweave.session import drop_intermediates, get_session, prepare, scratch_dir

__all__ = ["drop_intermediates", "get_session", "prepare", "scratch_dir"]
