"""Boxes: structs of x0, y0, x1, y1 in points, y downwards. A null box has no geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Null unless all four are finite numbers."""
    parts = [c.cast("double") for c in (x0, y0, x1, y1)]
    good = F.lit(True)
    for c in parts:
        good = good & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(good, F.struct(*(c.alias(n) for c, n in zip(parts, ("x0", "y0", "x1", "y1"), strict=True))))


def of_size(x: Column, y: Column, width: Column, height: Column) -> Column:
    return box(x, y, x + width, y + height)


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection_area(a: Column, b: Column) -> Column:
    across = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    down = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return across * down


def overlap_ratio(a: Column, b: Column) -> Column:
    """Of the smaller area; 0 if that is nothing."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection_area(a, b) / smaller).otherwise(0.0)


def vertical_overlap(a: Column, b: Column, clamp: bool = True) -> Column:
    """Of the smaller height."""
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    smaller = F.least(height(a), height(b))
    return F.when(smaller > 0, (F.greatest(F.lit(0.0), shared) if clamp else shared) / smaller).otherwise(0.0)


def horizontal_overlap(a: Column, b: Column, clamp: bool = True) -> Column:
    shared = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    smaller = F.least(width(a), width(b))
    return F.when(smaller > 0, (F.greatest(F.lit(0.0), shared) if clamp else shared) / smaller).otherwise(0.0)


def covers(a: Column, region: Column, least: float = 0.72) -> Column:
    """a covers most of the region and is of a similar size."""
    ra, aa = F.greatest(F.lit(1.0), area(region)), F.greatest(F.lit(1.0), area(a))
    return (intersection_area(a, region) / ra >= least) & (F.least(ra, aa) / F.greatest(ra, aa) >= 0.62)


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def normalised(b: Column, page: Column) -> Column:
    """As shares of the page, to six decimals."""
    w, h = F.greatest(F.lit(1.0), page["x1"] - page["x0"]), F.greatest(F.lit(1.0), page["y1"] - page["y0"])
    shares = ((b["x0"] - page["x0"]) / w, (b["y0"] - page["y0"]) / h, (b["x1"] - page["x0"]) / w, (b["y1"] - page["y0"]) / h)
    return F.struct(*(F.round(c, 6).alias(n) for c, n in zip(shares, ("x0", "y0", "x1", "y1"), strict=True)))


def padded(b: Column, page: Column, padding: float) -> Column:
    """Grown on all sides, inside the page."""
    return box(F.greatest(page["x0"], b["x0"] - padding), F.greatest(page["y0"], b["y0"] - padding), F.least(page["x1"], b["x1"] + padding), F.least(page["y1"], b["y1"] + padding))


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def from_matrix(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """The box of the unit square under the affine map x' = ax + cy + e, y' = bx + dy + f."""
    xs, ys = [e, e + a, e + c, e + a + c], [f, f + b, f + d, f + b + d]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def affine(a: Column, b: Column, body: float) -> Column:
    """The boxes overlap across, or their centres are near."""
    apart = F.abs((a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2)
    return (F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) > 0) | (apart <= F.greatest(F.lit(body * 8.0), (a["x1"] - a["x0"]) * 0.45))


def vertical_distance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a["y0"], b["y0"]) - F.least(a["y1"], b["y1"]))


def point_distance(x: Column, y: Column, b: Column) -> Column:
    """From a point to the nearest point of a box."""
    dx = F.greatest(b["x0"] - x, F.lit(0.0), x - b["x1"])
    dy = F.greatest(b["y0"] - y, F.lit(0.0), y - b["y1"])
    return F.sqrt(dx * dx + dy * dy)
