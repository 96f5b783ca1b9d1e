"""Fixed schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

TRACKS = "demo_id bigint, t int, point_id bigint, variant string, x double, y double, z double, u double, v double, vis double"
STEPS = "demo_id bigint, t int, action array<double>, state array<double>, done tinyint"
CAMERA = "demo_id bigint, t int, k array<double>, pose array<double>"
DEPTH = "demo_id bigint, t int, h int, w int, z array<double>"
CATALOG = "demo_id bigint, key_name string, shape array<int>, dtype string, size_n bigint"
ATTRS = "demo_id bigint, key string, value string"
STEP_LOG = "array<struct<joints:array<double>,gripper:double>>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
