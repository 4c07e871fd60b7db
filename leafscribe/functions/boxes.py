"""Box and polygon arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafscribe.functions.numbers import half_up


def box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def overlap(a: Column, b: Column) -> Column:
    """Area shared by two boxes."""
    across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    zero = F.lit(0.0)
    return F.greatest(zero, across) * F.greatest(zero, down)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is not positive."""
    shared = overlap(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, F.try_divide(shared, union)).otherwise(F.lit(0.0))


def can_suppress(b: Column) -> Column:
    """A box without positive area has IoU 0 with everything."""
    return (b["w"] > 0) & (b["h"] > 0)


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def crop_origin(value: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), half_up(value))


def crop_extent(value: Column, limit: Column, origin: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.least(half_up(value), limit.cast("long") - origin))


def in_box(px: Column, py: Column, b: Column) -> Column:
    return px.between(b["x"], b["x"] + b["w"]) & py.between(b["y"], b["y"] + b["h"])


def in_polygon(px: Column, py: Column, polygon: Column) -> Column:
    """Even-odd rule. Horizontal edges never cross the ray, so they cannot divide by zero."""
    rotated = F.concat(F.slice(polygon, -1, 1), F.slice(polygon, F.lit(1), F.size(polygon) - 1))

    def crosses(a: Column, b: Column) -> Column:
        slope = F.try_divide((b["x"] - a["x"]) * (py - a["y"]), b["y"] - a["y"])
        return ((a["y"] > py) != (b["y"] > py)) & F.coalesce(px < slope + a["x"], F.lit(False))

    return F.size(F.filter(F.zip_with(polygon, rotated, crosses), lambda c: c)) % 2 == 1


def in_shape(px: Column, py: Column, polygon: Column, b: Column) -> Column:
    """The polygon if it has at least three points, else the box with its border."""
    usable = F.coalesce(F.size(polygon) >= 3, F.lit(False))
    return F.when(usable, in_polygon(px, py, polygon)).otherwise(in_box(px, py, b))


def shifted(polygon: Column, dx: Column, dy: Column) -> Column:
    return F.transform(
        polygon, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))
    )
