"""Column expressions of capture geometry: poses, back-projection, plan axes, rings and intervals."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from planloom.constants import Z95


def rotation(qx: Column, qy: Column, qz: Column, qw: Column) -> list[list[Column]]:
    """Rows of the rotation matrix of a quaternion, which need not have length one."""
    n = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    x, y, z, w = qx / n, qy / n, qz / n, qw / n
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, [p * q for p, q in zip(a, b)])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def apply_rotation(rows: list[list[Column]], p: list[Column]) -> list[Column]:
    return [dot(r, p) for r in rows]


def back_project(u: Column, v: Column, d: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    return [(u - cx) / fx * d, (v - cy) / fy * d, d]


def scaled_intrinsics(fx, fy, cx, cy, rgb_w, rgb_h, depth_w, depth_h) -> list[Column]:
    return [fx * depth_w / rgb_w, fy * depth_h / rgb_h, cx * depth_w / rgb_w, cy * depth_h / rgb_h]


def assumed_intrinsics(w: Column, h: Column) -> list[Column]:
    """fx, fy, cx, cy of a camera of unknown make."""
    f = 0.85 * F.greatest(w, h)
    return [f, f, w / 2, h / 2]


def to_plan(x: Column, z: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return c * x + s * z, -s * x + c * z


def to_world(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return c * u - s * v, s * u + c * v


def cell(value: Column, origin: Column, res) -> Column:
    return F.floor((value - origin) / F.lit(res)).cast("int")


def cell_center(index: Column, origin: Column, res) -> Column:
    return origin + (index + 0.5) * F.lit(res)


def quarter_angle(nx: Column, nz: Column) -> Column:
    """Direction of a normal in the plan, modulo a quarter turn."""
    return F.pmod(F.atan2(nz, nx), F.lit(math.pi / 2))


def ring_next(c: Column, ring: WindowSpec, whole: WindowSpec) -> Column:
    return F.coalesce(F.lead(c).over(ring), F.first_value(c).over(whole))


def ring_before(c: Column, ring: WindowSpec, whole: WindowSpec) -> Column:
    return F.coalesce(F.lag(c).over(ring), F.last_value(c).over(whole))


def root_sum_square(*sigmas: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [s * s for s in sigmas]))


def interval(value: Column, sigma: Column) -> tuple[Column, Column]:
    """Both ends of the 95 % interval; lengths and areas never fall below zero."""
    return F.greatest(F.lit(0.0), value - Z95 * sigma), value + Z95 * sigma


def checked_sigma(value: Column, sigma: Column) -> Column:
    """The sigma, or an error where value or sigma is not finite or sigma is negative."""
    bad = F.isnan(value) | F.isnan(sigma) | (F.abs(value) == float("inf")) | (sigma == float("inf")) | (sigma < 0)
    return F.when(bad, F.raise_error(F.lit("measurement needs a finite value and a sigma of zero or more")).cast("double")).otherwise(sigma)


# Share of a value that its sigma is, and least sigma of wall lengths and ceiling heights.
PRIOR_SHARE = {"photos": 0.18, "video": 0.12}
PRIOR_WALL = {"envelope": 0.12, "segmented": 0.15}
PRIOR_CEILING = 0.2


def prior_sigma(value: Column, tier: Column, kind: str, layout: str = "envelope") -> Column:
    """Sigma without depth sensing: a share of the value by tier, twice that for areas; only lengths and heights have a floor.

    A layout is an envelope around a room's points or, for video alone, segmented by what the path saw.
    """
    share = F.when(tier == "photos", PRIOR_SHARE["photos"]).otherwise(PRIOR_SHARE["video"])
    if kind == "area":
        return 2 * share * value
    if kind == "perimeter":
        return share * value
    return F.greatest(F.lit({"length": PRIOR_WALL[layout], "height": PRIOR_CEILING}[kind]), share * value)


def evenly_spaced(n_rows: int, n: int) -> list[int]:
    """Positions of at most n evenly spaced rows of n_rows, both ends included."""
    n = min(n, n_rows)
    if n <= 1:
        return [0][:n]
    step = (n_rows - 1) / (n - 1)
    return sorted({int(i * step) if i < n - 1 else n_rows - 1 for i in range(n)})
