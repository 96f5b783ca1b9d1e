"""Camera and rigid-body expressions. Vectors are tuples of columns; 3x3 and 4x4 matrices are row-major
``array<double>`` columns (9 or 16 entries) read by position, so everything stays in generated code."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.functions.numeric import clip

Vec = Sequence[Column]


def at(m: Column, r: int, c: int, n: int = 4) -> Column:
    return F.get(m, F.lit(r * n + c))


def mat(rows: Sequence[Sequence[Column | float]]) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for r in rows for v in r])


def rotate(r: Column, p: Vec, n: int = 3) -> list[Column]:
    return [at(r, i, 0, n) * p[0] + at(r, i, 1, n) * p[1] + at(r, i, 2, n) * p[2] for i in range(3)]


def transform_point(pose: Column, p: Vec) -> list[Column]:
    """4x4 pose applied to a point."""
    return [v + at(pose, i, 3) for i, v in enumerate(rotate(pose, p, 4))]


def apply_sim3(scale: Column, rot: Column, trans: Vec, p: Vec) -> list[Column]:
    return [scale * v + t for v, t in zip(rotate(rot, p), trans)]


def apply_affine(a: Column, b: Vec, p: Vec) -> list[Column]:
    """Row-vector convention: p @ A + b."""
    return [p[0] * at(a, 0, j, 3) + p[1] * at(a, 1, j, 3) + p[2] * at(a, 2, j, 3) + b[j] for j in range(3)]


def sim3_matrix(scale: Column, rot: Column, trans: Vec) -> Column:
    """4x4 from scale, rotation and translation; with scale 1 the pose of (R, t)."""
    rows = [[scale * at(rot, i, j, 3) for j in range(3)] + [trans[i]] for i in range(3)]
    return mat(rows + [[0, 0, 0, 1]])


def lift_3x4(m: Column) -> Column:
    return F.concat(m, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))


def compose(a: Column, b: Column) -> Column:
    """Product of two 4x4 matrices."""
    return mat([[sum((at(a, i, k) * at(b, k, j) for k in range(1, 4)), at(a, i, 0) * at(b, 0, j)) for j in range(4)] for i in range(4)])


def rigid_inverse(t: Column) -> Column:
    """Inverse of a rotation plus translation: transposed rotation, rotated negative translation."""
    inv_t = [-(at(t, 0, i) * at(t, 0, 3) + at(t, 1, i) * at(t, 1, 3) + at(t, 2, i) * at(t, 2, 3)) for i in range(3)]
    return mat([[at(t, j, i) for j in range(3)] + [inv_t[i]] for i in range(3)] + [[0, 0, 0, 1]])


def with_inverse(df: DataFrame, source: str, out: str) -> DataFrame:
    """General 4x4 inverse, batch-wise; NULL where the matrix is singular. Meant for camera rows, one per frame."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.stack(b[source].to_numpy()).reshape(-1, 4, 4)
            ok = np.abs(np.linalg.det(m)) > 0
            inv = np.linalg.inv(np.where(ok[:, None, None], m, np.eye(4))).reshape(-1, 16)
            yield b.assign(**{out: [v if good else None for v, good in zip(inv, ok)]})

    return df.mapInPandas(invert, schema)


def project(fx: Column, fy: Column, cx: Column, cy: Column, cam: Vec, behind: str = "floor") -> tuple[Column, Column]:
    """Pinhole projection; depth is floored at 1e-6, or gives NULL at or below it (``behind='null'``)."""
    z = F.greatest(cam[2], F.lit(1e-6)) if behind == "floor" else F.when(cam[2] > 1e-6, cam[2])
    return fx * cam[0] / z + cx, fy * cam[1] / z + cy


def unproject(fx: Column, fy: Column, cx: Column, cy: Column, u: Column, v: Column, z: Column) -> list[Column]:
    return [(u - cx) * z / fx, (v - cy) * z / fy, z]


def quat_to_matrix(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Rotation of a (w, x, y, z) quaternion of any length; identity when it is (almost) zero."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (F.when(n < 1e-12, F.lit(1.0 if i == 0 else 0.0)).otherwise(q / n) for i, q in enumerate((w, x, y, z)))
    return mat([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


def quat_to_axis_angle(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    w = clip(w, -1.0, 1.0)
    den = F.sqrt(F.greatest(F.lit(0.0), 1.0 - w * w))
    return [F.when(den <= 1e-8, F.lit(0.0)).otherwise(q * 2.0 * F.acos(w) / den) for q in (x, y, z)]


def rotate180_camera(cx: Column, cy: Column, pose: Column, h: Column, w: Column) -> tuple[Column, Column, Column]:
    """Principal point and pose of the camera whose image was turned by 180 degrees."""
    flipped = mat([[at(pose, i, j) * (-1.0 if j < 2 else 1.0) for j in range(4)] for i in range(4)])
    return (w - 1) - cx, (h - 1) - cy, flipped


def bilinear(img: Column, h: int | Column, w: int | Column, u: Column, v: Column) -> Column:
    """Value of a row-major image at a real position, clamped to the border; four reads, no join per pixel."""
    w, h = (c if isinstance(c, Column) else F.lit(c) for c in (w, h))
    x, y = clip(u, F.lit(0.0), w - 1.0), clip(v, F.lit(0.0), h - 1.0)
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, w - 1), F.least(y0 + 1, h - 1)
    ax, ay = x - x0, y - y0

    def px(yy: Column, xx: Column) -> Column:
        return F.get(img, (yy * w + xx).cast("int"))

    return (1 - ax) * (1 - ay) * px(y0, x0) + (1 - ax) * ay * px(y1, x0) + ax * (1 - ay) * px(y0, x1) + ax * ay * px(y1, x1)


def patch_candidates(img: Column, h: int, w: int, u: Column, v: Column, radius: int) -> Column:
    """Array of (i, z, x, y, pd) for the pixels of the window around a position, row by row, NULL for pixels that are
    outside or not valid (finite, z > 0); pd is the pixel distance to the position. The window is written out pixel
    by pixel, so it compiles into plain reads."""
    cx, cy = F.rint(clip(u, 0.0, w - 1.0)).cast("int"), F.rint(clip(v, 0.0, h - 1.0)).cast("int")
    side = 2 * radius + 1
    out = []
    for i in range(side * side):
        px, py = cx + (i % side - radius), cy + (i // side - radius)
        z = F.get(img, py * w + px)
        ok = (px >= 0) & (px < w) & (py >= 0) & (py < h) & (z > 0) & (z < float("inf")) & ~F.isnan(z)
        out.append(F.when(ok, F.struct(F.lit(i).alias("i"), z.alias("z"), px.cast("double").alias("x"), py.cast("double").alias("y"),
                                       F.sqrt((px - u) * (px - u) + (py - v) * (py - v)).alias("pd"))))
    return F.array(*out)


def uv_scale(mode: Column, h: Column, w: Column) -> tuple[Column, Column]:
    """Factors that bring coordinates of a mode (518, normalized, pixels) to pixels."""
    def f(size: Column) -> Column:
        return (F.when(mode == "518", size / F.lit(518.0))
                .when(mode == "normalized", F.greatest(size - 1, F.lit(1)).cast("double")).otherwise(F.lit(1.0)))
    return f(w), f(h)


def detect_uv_mode(lo: Column, hi: Column, h: Column, w: Column) -> Column:
    """Scale of 2D coordinates from their range: larger than the image, within a unit box, or pixels."""
    return (F.when(hi > F.greatest(h, w) * 1.2, "518").when((hi <= 2.0) & (lo >= -0.5), "normalized").otherwise("pixels"))


def preprocess_geometry(h: Column, w: Column, mode: str, target: int = 518, keep_ratio: bool = False) -> dict[str, Column]:
    """Scale, padding and crop of the resize to multiples of 14 (width first for crop, longer side first for pad)."""
    def snapped(side: Column, other: Column) -> Column:
        return (F.rint(side * (F.lit(float(target)) / other) / 14) * 14).cast("int")

    zero, full = F.lit(0), F.lit(target)
    if mode == "pad":
        wide = w >= h
        rw, rh = F.when(wide, full).otherwise(snapped(w, h)), F.when(wide, snapped(h, w)).otherwise(full)
        return {"scale_x": rw / w, "scale_y": rh / h, "pad_left": F.floor((full - rw) / 2).cast("int"),
                "pad_top": F.floor((full - rh) / 2).cast("int"), "crop_left": zero, "crop_top": zero, "out_h": full, "out_w": full}
    rh = snapped(h, w)
    tall = rh > target if not keep_ratio else F.lit(False)
    return {"scale_x": full / w, "scale_y": rh / h, "pad_left": zero, "pad_top": zero, "crop_left": zero,
            "crop_top": F.when(tall, F.floor((rh - target) / 2).cast("int")).otherwise(zero),
            "out_h": F.when(tall, full).otherwise(rh), "out_w": full}


def camera_view(pose: Column, fy: Column, image_h: Column) -> dict[str, Column]:
    """Viewer camera of a pose: position, one unit ahead, up, vertical field of view (55 degrees if unknown)."""
    fwd, up = [at(pose, i, 2) for i in range(3)], [-at(pose, i, 1) for i in range(3)]
    fn, un = (F.sqrt(sum((v * v for v in vec[1:]), vec[0] * vec[0])) for vec in (fwd, up))
    ok = (fn >= 1e-6) & (un >= 1e-6)
    out = {}
    for i, a in enumerate("xyz"):
        out[f"pos_{a}"] = F.when(ok, at(pose, i, 3))
        out[f"target_{a}"] = F.when(ok, at(pose, i, 3) + fwd[i] / fn)
        out[f"up_{a}"] = F.when(ok, up[i] / un)
    out["fov"] = F.when(F.abs(fy) > 1e-6, F.degrees(2.0 * F.atan(0.5 * image_h / fy))).otherwise(F.lit(55.0))
    return out


# Stops of the colour ramp (position; red, green, blue).
RAMP = (
    (0.00, (0.03, 0.18, 0.95)),
    (0.18, (0.00, 0.66, 1.00)),
    (0.38, (0.00, 0.92, 0.40)),
    (0.58, (0.72, 0.96, 0.10)),
    (0.76, (1.00, 0.78, 0.05)),
    (0.90, (1.00, 0.34, 0.03)),
    (1.00, (0.86, 0.02, 0.02)),
)


def ramp_colour(scalar: Column) -> list[Column]:
    """Piecewise linear colour of a value in 0..1."""
    u = clip(scalar, 0.0, 1.0)
    out = []
    for ch in range(3):
        c = F.lit(RAMP[-1][1][ch])
        for (a, ca), (b, cb) in reversed(list(zip(RAMP, RAMP[1:]))):
            r = (u - a) / (b - a)
            c = F.when(u <= b, F.lit(ca[ch]) * (1.0 - r) + F.lit(cb[ch]) * r).otherwise(c)
        out.append(c)
    return out
