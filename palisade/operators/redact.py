"""Redaction plans: paints, merged regions, exact coverage, verdicts, text edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .grouped import by_group

# Padding of a painted region, gap that merges two, shares of the viewport for a verdict.
SAFETY_PAD, MERGE_GAP, HEAVY, REFUSE = 3, 6, 0.25, 0.6


def union_areas(rects: DataFrame, key: str, r: str = "r") -> DataFrame:
    """(key, area): the exact area of the union of each key's rectangles, in joins and
    windows: the distinct left and right edges cut a page into vertical strips; within a
    strip the rectangles that span it are merged by a running maximum of their bottoms."""
    own = rects.where(~g.is_empty(F.col(r))).select(key, F.col(f"{r}.x").alias("x0"), g.right(F.col(r)).alias("x1"), F.col(f"{r}.y").alias("y0"), g.bottom(F.col(r)).alias("y1")).distinct()
    edges = own.select(key, F.explode(F.array("x0", "x1")).alias("left")).distinct()
    strips = edges.withColumn("right", F.lead("left").over(Window.partitionBy(key).orderBy("left"))).where("right is not null")
    spans = strips.join(own, key).where("x0 <= left and x1 >= right")
    above = Window.partitionBy(key, "left").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.withColumn("to", F.max("y1").over(above))
    new = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce("to", F.col("y0"))))
    return covered.groupBy(key).agg(F.sum((F.col("right") - F.col("left")) * new).alias("area"))


def verdict(coverage: Column) -> Column:
    return F.when(coverage >= REFUSE, "refuse").when(coverage >= HEAVY, "heavy").otherwise("ok")


def coverage(union: Column, width: Column, height: Column) -> Column:
    return F.least(F.lit(1.0), union / F.greatest(F.lit(1.0), width * height))


def painted(rect: Column, bounds: Column) -> Column:
    """What a finding paints: padded, rounded outwards, clipped; null if nothing is left."""
    return g.intersection(g.round_out(g.inflate(rect, SAFETY_PAD)), bounds)


def merged(paints: DataFrame, page: str, mode: str, order: str, r: str = "r", kind: str = "pii_type") -> DataFrame:
    """Regions of one page and mode within MERGE_GAP of each other as one bounding box,
    until none are; (page, mode, x, y, width, height, pii_types). Regions start from the
    last in order, and each absorbs from the last, as the order can decide who meets whom.

    A page's regions are one group in one task: a page has at most a few thousand."""
    rows = paints.select(F.col(page).alias("page"), F.col(mode).alias("mode"), F.col(order).alias("ord"), f"{r}.x", f"{r}.y", f"{r}.width", f"{r}.height", F.col(kind).alias("kind"))

    def one(columns: list[list]) -> list[tuple]:
        ords, xs, ys, widths, heights, kinds_of = columns
        if len(ords) == 1:
            return [(xs[0], ys[0], xs[0] + widths[0] - xs[0], ys[0] + heights[0] - ys[0], kinds_of[0])]
        waiting = [(x, y, x + w, y + h, (k,)) for x, y, w, h, k in zip(xs, ys, widths, heights, kinds_of, strict=True)]
        out = []
        while waiting:
            x0, y0, x1, y1, kinds = waiting.pop()
            kinds, size = set(kinds), -1
            while size != len(waiting):
                size, rest = len(waiting), []
                for other in reversed(waiting):
                    a0, b0, a1, b1, more = other
                    if a0 < x1 + MERGE_GAP and x0 - MERGE_GAP < a1 and b0 < y1 + MERGE_GAP and y0 - MERGE_GAP < b1:
                        x0, y0, x1, y1 = min(x0, a0), min(y0, b0), max(x1, a1), max(y1, b1)
                        kinds.update(more)
                    else:
                        rest.append(other)
                waiting = rest[::-1]
            out.append((x0, y0, x1 - x0, y1 - y0, ",".join(sorted(kinds))))
        return out

    return by_group(rows, ["page", "mode"], ["ord", "x", "y", "width", "height", "kind"], one, "x double, y double, width double, height double, pii_types string")


def synthetic(pii_type: Column, value: Column) -> Column:
    """The value's shape: digits as 9, lower case as x, upper case as X (ASCII only)."""
    shape = F.translate(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[a-z]", "x"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X" * 26)
    return F.when(F.coalesce(value, F.lit("")) == "", F.concat(F.upper(pii_type), F.lit("_0"))).otherwise(shape)


def placeholder(pii_type: Column, slot: Column, index: Column) -> Column:
    """TYPE_SLOT, or TYPE_n without a slot."""
    return F.upper(F.concat_ws("_", pii_type, F.coalesce(slot, index.cast("string"))))


def resolve_mode(requested: Column, default: Column, never_blur: Column) -> Column:
    return F.when(requested.isNull(), default).when((requested == "blur") & never_blur, "mask_solid").otherwise(requested)


def fused(detections: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Detections of one type at one place as one finding: the strongest confidence, all
    detectors, the last slot and text seen, the first rectangle, any conflict."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
    return detections.groupBy(*keys).agg(
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"), F.sort_array(F.collect_set("detector")).alias("detectors"), last("slot"), last("matched_text"),
        F.min_by("rect", seq).alias("rect"), F.bool_or(F.coalesce("conflicting", F.lit(False))).alias("conflicting"), F.min(seq).alias("seq"), F.count("*").alias("n"),
    )


def planned(findings: DataFrame, page: str, bounds: Column) -> DataFrame:
    """Findings with their paint (null: skipped) and replacement. Placeholders without a
    slot are numbered by page in order of seq among findings that take one."""
    takes = (F.col("element_id").isNotNull()) & ~F.col("redaction").isin("drop", "synthetic", "none")
    index = F.sum(takes.cast("int")).over(Window.partitionBy(page).orderBy("seq")) - 1
    replacement = (
        F.when(F.col("element_id").isNull() | (F.col("redaction") == "none"), F.lit(None).cast("string"))
        .when(F.col("redaction") == "drop", F.lit(""))
        .when(F.col("redaction") == "synthetic", synthetic(F.col("pii_type"), F.col("matched_text")))
        .otherwise(placeholder(F.col("pii_type"), F.col("slot"), index))
    )
    paint = F.when(F.col("redaction") != "none", painted(F.col("rect"), bounds))
    return findings.withColumns({"replacement": replacement, "paint": paint})


def ranked(findings: DataFrame, page: str) -> DataFrame:
    """Findings with their rank on the page: the surest first, of equal ones the first found."""
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("confidence"), "seq", "start")))
