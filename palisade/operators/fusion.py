"""Structure and pixels joined by place: regions to elements, words to elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.stored import stored

# Overlap or containment that matches a region, containment of a word, least area of a pixel-only element.
MATCH_IOU, MATCH_CONTAINED, WORD_CONTAINED, LEAST_AREA = 0.45, 0.75, 0.6, 120


def _sided(rows: DataFrame, r: str, name: str) -> DataFrame:
    """Rectangles as plain columns, sides and area: a join's condition on fields of structs is so long a method that it isn't compiled."""
    r = F.col(r)
    sides = {"l": r["x"], "t": r["y"], "r": g.right(r), "b": g.bottom(r), "a": g.area(r)}
    return rows.withColumns({f"{name}_{k}": v for k, v in sides.items()})


def _shared() -> tuple[Column, Column]:
    """Whether rectangles i and o (``_sided``) share an area, and that area."""
    least, most = lambda k: F.least(f"i_{k}", f"o_{k}"), lambda k: F.greatest(f"i_{k}", f"o_{k}")
    return (least("r") > most("l")) & (least("b") > most("t")), (least("r") - most("l")) * (least("b") - most("t"))


def _matches() -> Column:
    """Overlap by MATCH_IOU, or MATCH_CONTAINED of i within o; neither is without a shared area."""
    meet, both = _shared()
    union = F.col("i_a") + F.col("o_a") - both
    return meet & (((union > 0) & (both / union >= MATCH_IOU)) | ((F.col("i_a") > 0) & (both / F.col("i_a") >= MATCH_CONTAINED)))


def _smallest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The element of least area for each key, the first of equal ones."""
    return pairs.groupBy(*keys).agg(F.min_by("element", F.struct(F.col("o_a").alias("a"), "element")).alias("element"))


def _pairs(regions: DataFrame, elements: DataFrame) -> DataFrame:
    """Regions i and elements o of a page."""
    inner, outer = _sided(regions.select("page_id", "n", "r"), "r", "i").drop("r"), _sided(elements.select("page_id", "element", "er"), "er", "o").drop("er")
    return inner.join(outer, "page_id")


def best_match(regions: DataFrame, elements: DataFrame) -> DataFrame:
    """regions (page_id, n, r ...) with the smallest visible element (page_id, element, er,
    hidden) that overlaps by MATCH_IOU or holds MATCH_CONTAINED of the region. The page is
    the join key; overlap is the condition on top."""
    return _smallest(_pairs(regions, elements.where("not hidden")).where(_matches()), ["page_id", "n"])


def owners(words: DataFrame, elements: DataFrame) -> DataFrame:
    """words (page_id, n, r) with the smallest element, hidden or not, that holds them."""
    meet, both = _shared()
    pairs = _pairs(words, elements).where(meet & (F.col("o_a") > 0) & (F.col("i_a") > 0) & (both / F.col("i_a") >= WORD_CONTAINED))
    return _smallest(pairs, ["page_id", "n"])


def fuse(elements: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, id, source, score): elements, fused where a region matches (the strongest
    counts), and regions that match nothing as elements of their own. Such a region can
    take in a later one that matches it; the earlier of two decides, in order of score."""
    # read twice
    matched = stored(best_match(regions, elements), "matched")
    strongest = matched.join(regions, ["page_id", "n"]).groupBy("page_id", "element").agg(F.max("score").alias("score"))
    structure = elements.join(strongest, ["page_id", "element"], "left").select(
        "page_id", F.concat(F.lit("el_"), F.col("element")).alias("id"), F.when(F.col("score").isNull(), "structure").otherwise("fused").alias("source"), F.coalesce("score", F.lit(1.0)).alias("score")
    )
    alone = regions.join(matched, ["page_id", "n"], "left_anti").where(g.area(F.col("r")) >= LEAST_AREA)
    later = _sided(alone.select("page_id", "n", "r", "score"), "r", "i").drop("r")
    earlier = _sided(alone.select("page_id", F.col("n").alias("element"), "r", F.col("score").alias("escore")), "r", "o").drop("r")
    absorbed = later.join(earlier, "page_id").where(_matches() & (F.struct(-F.col("escore"), "element") < F.struct(-F.col("score"), "n"))).select("page_id", "n").distinct()
    left = alone.join(absorbed, ["page_id", "n"], "left_anti")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "n")) - 1
    return structure.unionByName(left.select("page_id", F.concat(F.lit("px_"), place).alias("id"), F.lit("pixel").alias("source"), "score"))
