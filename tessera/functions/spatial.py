"""Points as struct<x,y,z> and predicates on them; plain arithmetic, so box filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    z = F.lit(0.0) if z is None else z
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def distance(p: Column, x: float, y: float, z: float = 0.0) -> Column:
    return F.sqrt(squared(p, x, y, z))


def squared(p: Column, x: float, y: float, z: float = 0.0) -> Column:
    parts = [p[axis] - F.lit(float(v)) for axis, v in zip("xyz", (x, y, z), strict=True)]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def point_distance(a: Column, b: Column) -> Column:
    parts = [a[axis] - b[axis] for axis in "xyz"]
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def within(p: Column, low: tuple[float, ...], high: tuple[float, ...]) -> Column:
    """Inclusive box in two or three dimensions."""
    found = F.lit(True)
    for axis, a, b in zip("xyz", low, high, strict=False):
        found = found & p[axis].between(float(a), float(b))
    return found


def within_radius(p: Column, c: Column, r: float) -> Column:
    """In the plane."""
    dx, dy = p["x"] - c["x"], p["y"] - c["y"]
    return F.sqrt(dx * dx + dy * dy) <= F.lit(float(r))


def on_top_of(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) < 1) & (a["y"] > b["y"])


def radius_3d(p: Column, x: float, y: float, z: float, r: float) -> Column:
    return squared(p, x, y, z) <= F.lit(float(r) * float(r))
