"""Rectangles as struct<x,y,width,height>: half-open, so touching edges do not overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, width, height) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x, y, width, height), ("x", "y", "width", "height"), strict=True)])


def right(r: Column) -> Column:
    return r["x"] + r["width"]


def bottom(r: Column) -> Column:
    return r["y"] + r["height"]


def area(r: Column) -> Column:
    """Negative sides count as none."""
    return F.greatest(r["width"], F.lit(0.0)) * F.greatest(r["height"], F.lit(0.0))


def is_empty(r: Column) -> Column:
    return (r["width"] <= 0) | (r["height"] <= 0)


def center(r: Column) -> Column:
    return F.struct((r["x"] + r["width"] / 2).alias("x"), (r["y"] + r["height"] / 2).alias("y"))


def intersection(a: Column, b: Column) -> Column:
    """Null if the two share no area."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w, h = F.least(right(a), right(b)) - x, F.least(bottom(a), bottom(b)) - y
    return F.when((w > 0) & (h > 0), rect(x, y, w, h))


def intersection_area(a: Column, b: Column) -> Column:
    # no struct is made of it: conditions of joins have it several times, and a long method isn't compiled
    w, h = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"]), F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def union_area(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection_area(a, b)


def iou(a: Column, b: Column) -> Column:
    u = union_area(a, b)
    return F.when(u > 0, intersection_area(a, b) / u).otherwise(F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    own = area(inner)
    return F.when(own > 0, intersection_area(inner, outer) / own).otherwise(F.lit(0.0))


def contains_point(r: Column, x: Column, y: Column) -> Column:
    return (x >= r["x"]) & (x < right(r)) & (y >= r["y"]) & (y < bottom(r))


def inflate(r: Column, by) -> Column:
    by = F.lit(float(by)) if not isinstance(by, Column) else by
    return rect(r["x"] - by, r["y"] - by, r["width"] + 2 * by, r["height"] + 2 * by)


def scale(r: Column, by) -> Column:
    return rect(r["x"] * by, r["y"] * by, r["width"] * by, r["height"] * by)


def round_out(r: Column) -> Column:
    """The least rectangle of whole numbers around it."""
    x, y = F.floor(r["x"]), F.floor(r["y"])
    return rect(x, y, F.ceil(right(r)) - x, F.ceil(bottom(r)) - y)


def half_up(v: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(v + 0.5)


def to_tuple(r: Column) -> Column:
    return F.array(*[half_up(r[c]).cast("int") for c in ("x", "y", "width", "height")])


def bounding_box(of: str) -> Column:
    """Aggregate: the least rectangle around all of a group's (column name)."""
    r = F.col(of)
    x, y = F.min(r["x"]), F.min(r["y"])
    return rect(x, y, F.max(right(r)) - x, F.max(bottom(r)) - y)


def span_rect(r: Column, text: Column, start: Column, end: Column) -> Column:
    """Where a span of an element's text stands: its share of the width, padded by a
    character (two pixels at least). The whole element, if its text likely takes several lines."""
    n = F.length(text)
    several = (r["height"] > 32) & (6 * n > 1.5 * r["width"])
    cw = r["width"] / F.greatest(n, F.lit(1))
    pad = F.greatest(F.lit(2.0), cw)
    x = F.greatest(r["x"], r["x"] + start * cw - pad)
    stop = F.least(right(r), r["x"] + end * cw + pad)
    return F.when((n == 0) | several, r).otherwise(rect(x, r["y"], F.greatest(F.lit(1.0), stop - x), r["height"]))
