"""Geometry of boxes as Column expressions: rectangles are columns x0, y0, x1, y1 with an optional prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def rect(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + s) for s in SIDES)


def area(r: tuple[Column, ...]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, r[2] - r[0]) * F.greatest(zero, r[3] - r[1])


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...], share: float = 0.9, larger: float = 1.05) -> Column:
    """outer holds share of inner and is clearly larger, so containment has no cycle."""
    a = area(inner)
    return (a > 0) & (area(outer) > larger * a) & (intersection(outer, inner) / F.when(a > 0, a) >= share)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(value, high))


def x_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over the wider one's length."""
    wide = F.greatest(a1 - a0, b1 - b0)
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / F.when(wide > 0, wide)


def homography(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """The point mapped by a 3 x 3 matrix given row by row."""
    if len(m) != 9:
        raise ValueError("a homography has nine numbers")
    w = x * float(m[6]) + y * float(m[7]) + float(m[8])
    w = F.when(F.abs(w) >= 1e-12, w)
    return (x * float(m[0]) + y * float(m[1]) + float(m[2])) / w, (x * float(m[3]) + y * float(m[4]) + float(m[5])) / w


def bounds(points: Column) -> Column:
    """The bounding rectangle of an array of (x, y) structs."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def signed_area(points: Column) -> Column:
    """Shoelace area of a polygon, an array of (x, y) structs."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule."""
    n = F.size(points)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(points, (i + n - 1) % n)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"]
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(points, crosses), F.lit(0), lambda s, t: s + t) % 2 == 1


def crop_rectangle(r: tuple[Column, ...], width: Column, height: Column) -> Column:
    """Pixels of a crop: clamped first, then floor of the start and ceiling of the end; null where not finite or empty."""
    finite = None
    for v in r:
        ok = v.isNotNull() & ~F.isnan(v)
        finite = ok if finite is None else finite & ok
    x0, y0 = F.floor(clamp(r[0], 0.0, width.cast("double"))), F.floor(clamp(r[1], 0.0, height.cast("double")))
    x1, y1 = F.ceil(clamp(r[2], 0.0, width.cast("double"))), F.ceil(clamp(r[3], 0.0, height.cast("double")))
    return F.when(finite & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
