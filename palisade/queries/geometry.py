"""Queries over rectangles: scalar geometry, unions, coverage, merging, spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import fusion, redact
from ..sources.derived import RECTS_SQL, rects, table
from .registry import Registry

query = Registry()

_AREA = "greatest({w}, 0) * greatest({h}, 0)"


@query(f"""
  WITH r AS ({RECTS_SQL}), p AS (
    SELECT a.page_id, a.n, b.n AS m, a.x, a.y, a.w, a.h, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh,
           least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih
    FROM r a JOIN r b ON a.page_id = b.page_id AND b.n = a.n + 1), i AS (
    SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih ELSE 0 END AS inter FROM p)
  SELECT page_id, n, w * h AS area, inter, w * h + bw * bh - inter AS union_area, round(inter / (w * h + bw * bh - inter), 9) AS iou,
         round(inter / (w * h), 9) AS contained, x + w / 2 AS cx, y + h / 2 AS cy,
         (bx + bw / 2 >= x AND bx + bw / 2 < x + w AND by_ + bh / 2 >= y AND by_ + bh / 2 < y + h) AS has_center,
         floor(x / 3 - 1.5) AS out_x, ceil((x + w) / 3 + 1.5) - floor(x / 3 - 1.5) AS out_w, floor(y / 3 + 0.5)::INT AS half_up
  FROM i""")
def rectangle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rectangle with the next one of its page: areas, overlap, containment, rounding."""
    r = rects(spark, sf_dir)
    b = r.select("page_id", (F.col("n") - 1).alias("n"), F.col("r").alias("b"))
    a, o = F.col("r"), F.col("b")
    out = g.round_out(g.inflate(g.scale(a, 1 / F.lit(3.0)), 1.5))
    return r.join(b, ["page_id", "n"]).select(
        "page_id", "n", g.area(a).alias("area"), g.intersection_area(a, o).alias("inter"), g.union_area(a, o).alias("union_area"), F.round(g.iou(a, o), 9).alias("iou"),
        F.round(g.containment(a, o), 9).alias("contained"), g.center(a)["x"].alias("cx"), g.center(a)["y"].alias("cy"),
        g.contains_point(a, g.center(o)["x"], g.center(o)["y"]).alias("has_center"), out["x"].alias("out_x"), out["width"].alias("out_w"),
        g.half_up(a["y"] / 3).cast("int").alias("half_up"),
    )


_GRID = f"""
  WITH r AS ({RECTS_SQL}), xs AS (SELECT DISTINCT page_id, unnest([x, x + w]) AS v FROM r), ys AS (SELECT DISTINCT page_id, unnest([y, y + h]) AS v FROM r),
  xc AS (SELECT page_id, v AS x0, lead(v) OVER (PARTITION BY page_id ORDER BY v) AS x1 FROM xs), yc AS (SELECT page_id, v AS y0, lead(v) OVER (PARTITION BY page_id ORDER BY v) AS y1 FROM ys),
  cells AS (SELECT xc.page_id, x0, x1, y0, y1 FROM xc JOIN yc USING (page_id) WHERE x1 IS NOT NULL AND y1 IS NOT NULL
            AND EXISTS (SELECT 1 FROM r WHERE r.page_id = xc.page_id AND r.x <= x0 AND r.x + r.w >= x1 AND r.y <= y0 AND r.y + r.h >= y1)),
  u AS (SELECT page_id, sum((x1 - x0) * (y1 - y0)) AS area FROM cells GROUP BY 1),
  b AS (SELECT page_id, count(*) AS n, sum(w * h) AS summed, max(w * h) AS largest, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM r GROUP BY 1)
  SELECT page_id, n, summed, largest, area, x, y, width, height, floor(least(1.0, area / 1024000) * 10000 + 0.5) / 10000 AS coverage,
         CASE WHEN area / 1024000 >= 0.6 THEN 'refuse' WHEN area / 1024000 >= 0.25 THEN 'heavy' ELSE 'ok' END AS verdict,
         CASE WHEN n > 6 OR summed / 1024000 > 0.55 THEN 'full' ELSE 'regions' END AS reading
  FROM b JOIN u USING (page_id)"""


@query(_GRID)
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact union area by page, bounding box, coverage verdict, crop-or-full decision."""
    r = rects(spark, sf_dir)
    sums = r.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(g.area(F.col("r"))).alias("summed"), F.max(g.area(F.col("r"))).alias("largest"), g.bounding_box("r").alias("box"))
    cover = redact.coverage(F.col("area"), F.lit(1280.0), F.lit(800.0))
    return sums.join(redact.union_areas(r, "page_id"), "page_id").select(
        "page_id", "n", "summed", "largest", "area", "box.*", (F.floor(cover * 10000 + 0.5) / 10000).alias("coverage"), redact.verdict(cover).alias("verdict"),
        F.when((F.col("n") > 6) | (F.col("summed") / 1024000 > 0.55), "full").otherwise("regions").alias("reading"),
    )


@query()
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded regions merged by page and mode (order-sensitive: tested against brute force)."""
    r = rects(spark, sf_dir)
    paints = r.select("page_id", "n", "mode", redact.painted(F.col("r"), g.rect(*map(F.lit, (0, 0, 1280, 800)))).alias("r"), F.concat(F.lit("t"), F.col("n") % 3).alias("pii_type"))
    return redact.merged(paints.where("r is not null"), "page_id", "mode", "n")


_FUSION_SRC = f"""
  WITH el AS (SELECT page_id, n, x, y, w, h, mode = 'blur' AS hidden FROM ({RECTS_SQL})),
  reg AS (SELECT l_orderkey AS page_id, l_linenumber AS n, (l_partkey * 3 % 1280)::DOUBLE AS x, (l_suppkey * 8 % 800)::DOUBLE AS y, (l_quantity::INT * 3 + 20)::DOUBLE AS w,
                 (12 + 5 * l_linenumber)::DOUBLE AS h, round(l_discount * 10, 2) AS score FROM lineitem WHERE l_discount >= 0.008)"""


@query(_FUSION_SRC + """,
  o AS (SELECT reg.page_id, reg.n, el.n AS element, el.w * el.h AS area, greatest(0, least(reg.x + reg.w, el.x + el.w) - greatest(reg.x, el.x)) * greatest(0, least(reg.y + reg.h, el.y + el.h) - greatest(reg.y, el.y)) AS inter,
               reg.w * reg.h AS own, el.w * el.h AS other
        FROM reg JOIN el USING (page_id) WHERE NOT hidden),
  m AS (SELECT page_id, n, element, row_number() OVER (PARTITION BY page_id, n ORDER BY area, element) AS rank FROM o WHERE inter / (own + other - inter) >= 0.45 OR inter / own >= 0.75)
  SELECT page_id, n, element FROM m WHERE rank = 1""")
def regions_on_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detected region with the smallest visible element that it matches."""
    return fusion.best_match(_regions(spark, sf_dir), _elements(spark, sf_dir)).select("page_id", "n", "element")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects(spark, sf_dir).select("page_id", F.col("n").alias("element"), F.col("r").alias("er"), (F.col("mode") == "blur").alias("hidden"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").where("l_discount >= 0.008").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n"), F.round(F.col("l_discount") * 10, 2).alias("score"),
        g.rect(F.col("l_partkey") * 3 % 1280, F.col("l_suppkey") * 8 % 800, q * 3 + 20, 12 + 5 * F.col("l_linenumber")).alias("r"),
    )


@query(_FUSION_SRC + """,
  o AS (SELECT reg.page_id, reg.n, el.n AS element, el.w * el.h AS area, greatest(0, least(reg.x + reg.w, el.x + el.w) - greatest(reg.x, el.x)) * greatest(0, least(reg.y + reg.h, el.y + el.h) - greatest(reg.y, el.y)) AS inter,
               reg.w * reg.h AS own
        FROM reg JOIN el USING (page_id)),
  m AS (SELECT page_id, n, element, row_number() OVER (PARTITION BY page_id, n ORDER BY area, element) AS rank FROM o WHERE area > 0 AND inter / own >= 0.6)
  SELECT page_id, element, count(*) AS words FROM m WHERE rank = 1 GROUP BY ALL""")
def words_on_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words by the smallest element that holds them (hidden ones too)."""
    return fusion.owners(_regions(spark, sf_dir), _elements(spark, sf_dir)).groupBy("page_id", "element").agg(F.count("*").alias("words"))


@query()
def fused_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure and pixels as one element table (growing list: tested on fixtures)."""
    return fusion.fuse(_elements(spark, sf_dir), _regions(spark, sf_dir))


@query(f"""
  WITH reg AS (SELECT l_orderkey // 8 AS page_id, l_orderkey * 8 + l_linenumber AS n, l_discount AS score, l_quantity::INT - 1 AS w FROM lineitem)
  SELECT page_id, n, rank FROM (SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, n) AS rank FROM reg WHERE score >= 0.08 AND w > 1) WHERE rank <= 120""")
def top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 120 strongest regions of each page: the limit is the feature."""
    reg = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 8").alias("page_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"), F.col("l_discount").alias("score"), (F.col("l_quantity").cast("int") - 1).alias("w")
    ).where("score >= 0.08 and w > 1")
    return reg.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "n")).cast("long")).where("rank <= 120").select("page_id", "n", "rank")


@query(f"""
  WITH r AS ({RECTS_SQL}), p AS (SELECT page_id, n, x, y, w, h, mode FROM r),
  bad AS (SELECT a.page_id, a.n FROM p a WHERE a.mode = 'mask_solid' AND NOT EXISTS (
    SELECT 1 FROM p b WHERE b.page_id = a.page_id AND b.mode <> 'mask_solid'
      AND greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / (a.w * a.h) >= 0.97))
  SELECT page_id, count(*) AS uncovered FROM bad GROUP BY 1""")
def uncovered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that must be masked and that no paint covers to 97 %: an anti join by page."""
    r = rects(spark, sf_dir)
    asked = r.where("mode = 'mask_solid'").alias("a")
    paints = r.where("mode <> 'mask_solid'").alias("b")
    return asked.join(paints, (F.col("a.page_id") == F.col("b.page_id")) & (g.containment(F.col("a.r"), F.col("b.r")) >= 0.97), "left_anti").groupBy("page_id").agg(F.count("*").alias("uncovered"))


QUERIES, ORACLE = query.queries, query.oracle
