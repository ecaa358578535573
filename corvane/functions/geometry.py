"""Boxes and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes {a}x, {a}y, {a}w, {a}h and {b}x, …; 0 where the union is not positive."""
    c = lambda p, k: F.col(f"{p}{k}").cast("double")
    side = lambda k, n: F.greatest(F.lit(0.0), F.least(c(a, k) + c(a, n), c(b, k) + c(b, n)) - F.greatest(c(a, k), c(b, k)))
    common = side("x", "w") * side("y", "h")
    union = c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def evens(coords: Column) -> Column:
    """x of a flat list x1, y1, x2, y2, …"""
    return F.filter(coords, lambda v, i: i % 2 == 0)


def odds(coords: Column) -> Column:
    """y of a flat list x1, y1, x2, y2, …"""
    return F.filter(coords, lambda v, i: i % 2 == 1)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where lambdas inside body use it."""
    return F.transform(F.array(value), body)[0]


def shoelace_area(coords: Column) -> Column:
    """Area of the polygon with these flat coordinates."""

    def area(c: Column) -> Column:
        n = F.size(c)
        pairs = F.transform(F.sequence(F.lit(0), n - 2, F.lit(2)), lambda i: F.get(c, i) * F.get(c, (i + 3) % n) - F.get(c, (i + 2) % n) * F.get(c, i + 1))
        return F.when(n >= 6, F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(F.lit(0.0))

    return let(coords, area)


def scaled(coords: Column, width: Column, height: Column, clamp: bool = True) -> Column:
    """Normalised coordinates in pixels, clamped to the image first if asked for."""
    unit = (lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))) if clamp else (lambda v: v)
    return F.transform(coords, lambda v, i: unit(v) * F.when(i % 2 == 0, width).otherwise(height))


def polygon_bbox(coords: Column) -> Column:
    """x, y, w, h around flat coordinates, rounded to 2 places."""
    x, y = evens(coords), odds(coords)
    r = lambda v: F.round(v, 2)
    return F.struct(r(F.array_min(x)).alias("x"), r(F.array_min(y)).alias("y"), r(F.array_max(x) - F.array_min(x)).alias("w"), r(F.array_max(y) - F.array_min(y)).alias("h"))


def box_polygon(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The rectangle's flat coordinates inside the image; null if nothing of it is inside."""
    x0, y0, x1, y1 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0)), F.least(x + w, width), F.least(y + h, height)
    return F.when((x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y0, x1, y1, x0, y1))


def corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """x, y, w, h of a box given by any two opposite corners."""
    return F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("w"), F.abs(y1 - y0).alias("h"))
