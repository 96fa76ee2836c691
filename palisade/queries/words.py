"""Queries over recognised words, crops, propagated values and sealed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import rect
from ..operators import screen, words
from ..sources.derived import dealt, table
from .registry import Registry
from .text import _POLICY_SQL, pattern_ctes

query = Registry()


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested frames by order: a line item a word, two words a line."""
    q = F.col("l_quantity").cast("int")
    word = F.struct(
        F.concat(F.lit("w"), F.col("l_partkey")).alias("text"), ((F.col("l_linenumber") % 2) * 300).cast("double").alias("x0"), (F.col("l_linenumber") * 15).cast("double").alias("y0"),
        ((F.col("l_linenumber") % 2) * 300 + q - 2).cast("double").alias("x1"), (F.col("l_linenumber") * 15 + 10).cast("double").alias("y1"), F.round(F.col("l_discount") * 1000).alias("confidence"),
    )
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", word.alias("w")))).alias("ws"))
    line = F.array(F.struct(F.transform("ws", lambda x: x["w"]).alias("words")))
    return rows.select("page_id", F.array(F.struct(F.array(F.struct(line.alias("lines"))).alias("paragraphs"))).alias("blocks"))


@query("""
  SELECT l_orderkey AS page_id, count(*) AS n, sum(l_quantity::INT - 2)::DOUBLE AS width, round(avg(round(l_discount * 1000) / 100), 6) AS confidence
  FROM lineitem WHERE l_quantity::INT > 2 AND round(l_discount * 1000) / 100 >= 0.4 GROUP BY 1""")
def flattened_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of nested frames that are legible, counted by page."""
    return words.flattened(_frames(spark, sf_dir), "page_id", "blocks").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("width").alias("width"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query()
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words grouped to lines (each line's centre moves as it grows: tested on fixtures)."""
    return words.lines(words.flattened(_frames(spark, sf_dir), "page_id", "blocks"))


@query()
def reading_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to read, padded and united (order-sensitive: tested on fixtures)."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 1280).cast("double").alias("x"), (F.col("l_suppkey") * 8 % 800).cast("double").alias("y"),
        (F.col("l_quantity").cast("int") * 4).cast("double").alias("width"), (16 + 4 * F.col("l_linenumber")).cast("double").alias("height"),
    )
    return words.crops(rows)


_P = "o_custkey AS page_id, 'f' || o_orderkey % 7 AS field, o_orderkey"


@query(f"""
  WITH f AS (SELECT {_P}, CASE WHEN o_orderkey % 2 = 0 THEN 'pan' ELSE 'phone' END AS pii_type, 'val' || lpad((o_orderkey % 11)::VARCHAR, 3, '0') AS value, round(0.5 + (o_orderkey % 5) / 10.0, 2)::DOUBLE AS confidence FROM orders WHERE o_orderkey % 3 = 0),
  t AS (SELECT {_P}, 'has val' || lpad((o_orderkey % 11)::VARCHAR, 3, '0') || ' in it' AS text FROM orders WHERE o_orderkey % 3 <> 0),
  k AS (SELECT page_id, pii_type, value, max(confidence) AS confidence FROM f GROUP BY ALL)
  SELECT DISTINCT t.page_id, t.field, k.pii_type, k.value, k.confidence FROM t JOIN k USING (page_id)
  WHERE contains(t.text, k.value) AND NOT EXISTS (SELECT 1 FROM f WHERE f.page_id = t.page_id AND f.field = t.field AND f.pii_type = k.pii_type AND f.value = k.value)""")
def propagated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values found on a page looked for in its other texts."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.concat(F.lit("f"), k % 7).alias("field"), "o_orderkey")
    value = F.concat(F.lit("val"), F.lpad((k % 11).cast("string"), 3, "0"))
    found = o.where(k % 3 == 0).select("page_id", "field", F.when(k % 2 == 0, "pan").otherwise("phone").alias("pii_type"), value.alias("matched_text"), F.round(0.5 + (k % 5) / 10, 2).alias("confidence"), F.lit(None).cast("string").alias("slot"))
    texts = o.where(k % 3 != 0).select("page_id", "field", F.concat(F.lit("has "), value, F.lit(" in it")).alias("text"))
    return words.propagated(found, texts).drop("slot")


@query("SELECT c_custkey AS k, c_name AS value, true AS hidden, c_custkey % 2 = 0 AS opens FROM customer")
def sealed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values sealed with AES-GCM and opened with the right key, or (odd ones) tried with a wrong one."""
    k = F.col("c_custkey")
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    other = F.lit("f123456789abcdef0123456789abcdef").cast("binary")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_name").alias("value"), words.sealed(F.col("c_name").cast("binary"), key, F.lpad(k.cast("string"), 12, "0").cast("binary")).alias("sealed"))
    with_key = F.when(F.col("k") % 2 == 0, words.opened(F.col("sealed"), key)).otherwise(words.opened(F.col("sealed"), other))
    return rows.select("k", "value", (~F.contains("sealed", F.col("value"))).alias("hidden"), with_key.eqNullSafe(F.col("value")).alias("opens"))


# ---- whole screens ---------------------------------------------------------------------------------
def screens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, words and stored values by customer: an identifier read in three parts, a labelled phone number,
    an address that reading has cut in two, and a button that repeats the phone number."""
    k = F.col("c_custkey")
    customers = dealt(table(spark, sf_dir, "customer").select(k.alias("page_id")))
    k = F.col("page_id")
    digits = lambda v, n: F.lpad((v % 10**n).cast("string"), n, "0")
    aadhaar = F.concat(digits(k % 8 + 2, 1), digits(k * 7919, 11))
    phone = F.concat((k % 4 + 6).cast("string"), digits(k * 17, 9))
    said = [(0, F.substring(aadhaar, 1, 4)), (0, F.substring(aadhaar, 5, 4)), (0, F.substring(aadhaar, 9, 4)), (1, F.lit("phone")), (1, phone), (2, F.concat(F.lit("u"), k)), (2, F.lit("@x.org"))]
    rows = F.array(*[F.struct(F.lit(j).alias("n"), t.alias("text"), F.lit(100.0 * j).alias("x"), F.lit(30.0 * line + j % 2).alias("y"), ((k * 3 + j * 7) % 11 / 10).alias("confidence")) for j, (line, t) in enumerate(said)])
    read = customers.select("page_id", F.inline(rows)).select("*", F.lit(90.0).alias("width"), F.lit(12.0).alias("height"))
    null = F.lit(None).cast("string")
    elements = customers.select(
        "page_id", F.lit("el_0").alias("element_id"), F.lit(0).alias("n"), rect(*map(F.lit, (0, 200, 180, 24))).alias("rect"), F.lit("button").alias("role"),
        F.when(k % 3 == 0, F.concat(F.lit("Call "), phone)).otherwise("Home").alias("name"), F.lit(1.0).alias("confidence"),
        *[null.alias(c) for c in ("text", "value", "placeholder", "field_name", "input_type", "autocomplete", "label", "ocr_text")],
    )
    vault = customers.where(k % 2 == 0).select("page_id", F.lit(0).cast("long").alias("seq"), F.lit("email").alias("pii_type"), F.concat(F.lit("u"), k, F.lit("@x.org")).alias("value"), F.lit("own").alias("slot"))
    return elements, read, vault


_SCREEN = """
  c AS (SELECT c_custkey AS page_id, (c_custkey % 8 + 2)::VARCHAR || lpad((c_custkey * 7919 % 100000000000)::VARCHAR, 11, '0') AS a,
               (c_custkey % 4 + 6)::VARCHAR || lpad((c_custkey * 17 % 1000000000)::VARCHAR, 9, '0') AS p FROM customer),
  w AS (SELECT page_id, j, line, text, (page_id * 3 + j * 7) % 11 / 10.0::DOUBLE AS read, j * 100 AS x, line * 30 + j % 2 AS y FROM c,
        LATERAL (VALUES (0, 0, substr(a, 1, 4)), (1, 0, substr(a, 5, 4)), (2, 0, substr(a, 9, 4)), (3, 1, 'phone'), (4, 1, p), (5, 2, 'u' || page_id), (6, 2, '@x.org')) AS t(j, line, text)),
  t AS (SELECT page_id * 100 + j AS k, page_id, text, read, 'ocr:' || x || ':' || y || ':90:12' AS location, NULL AS field FROM w
        UNION ALL SELECT page_id * 100 + 10 + line * 2 + v, page_id, if(v = 0, array_to_string(list(text ORDER BY j), ' '), array_to_string(list(text ORDER BY j), '')), avg(read), 'ocr:' || min(x) || ':' || min(y) || ':' || (max(x) + 90 - min(x)) || ':' || (max(y) + 12 - min(y)), 'ocr'
          FROM w, (VALUES (0), (1)) AS q(v) GROUP BY page_id, line, v
        UNION ALL SELECT page_id * 100 + 50, page_id, if(page_id % 3 = 0, 'Call ' || p, 'Home'), NULL, 'el_0', 'name' FROM c)"""


@query(f"WITH {_SCREEN.strip()}, {pattern_ctes('SELECT k, text FROM t')}" + f""",
  d AS (
    SELECT page_id, pii_type, location, field, if(field IS NULL, NULL, start) AS start, if(field IS NULL, NULL, "end") AS "end", confidence * if(read IS NULL, 1, greatest(0.5, read)) AS confidence, 'pattern' AS detector, NULL AS slot
    FROM accepted JOIN t USING (k)
    UNION ALL SELECT page_id, 'email', location, field, 0, len(text), greatest(0.5, read), 'known_value', 'own' FROM t WHERE page_id % 2 = 0 AND text = 'u' || page_id || '@x.org'),
  f AS (SELECT page_id, pii_type, location, field, start::BIGINT AS start, "end"::BIGINT AS "end", max(confidence) AS confidence, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, max(slot) AS slot FROM d GROUP BY ALL)
  SELECT page_id, f.pii_type, location, coalesce(field, '') AS field, coalesce(start, -1) AS start, coalesce("end", -1) AS "end", round(confidence, 6) AS confidence, detectors, coalesce(slot, '') AS slot, redaction FROM f JOIN {_POLICY_SQL} ON p.pii_type = f.pii_type WHERE confidence >= threshold""")
def screen_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen's elements, words and lines show, each place once, if it is sure enough."""
    found = screen.findings(screen.detections(*screens(spark, sf_dir)))
    return found.select(
        "page_id", "pii_type", "location", F.coalesce("field", F.lit("")).alias("field"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("start", "end")],
        F.round("confidence", 6).alias("confidence"), F.array_join("detectors", ",").alias("detectors"), F.coalesce("slot", F.lit("")).alias("slot"), "redaction",
    )


QUERIES, ORACLE = query.queries, query.oracle
