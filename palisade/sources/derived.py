"""Inputs derived from the test tables by integer arithmetic, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import rect


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows for work that is dear by the row: dealt out to all cores if their files make fewer
    tasks than there are cores. A large table has more and is left as it is, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of which much is made that one task takes.
TASK_ROWS = 20_000


def dealt(rows: DataFrame) -> DataFrame:
    """Few and narrow columns of rows of which much is made, dealt to as many tasks as their number asks for: files
    don't tell, as a group of rows of a Parquet file is read by one task, whatever it is cut into."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS)))


def _letter(k: Column) -> Column:
    return F.char((k % 26 + 65).cast("long"))


def _digits(k: Column, n: int) -> Column:
    return F.lpad((k % 10**n).cast("string"), n, "0")


def id_candidates(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> DataFrame:
    """(k, kind, value): identifiers of all shapes by order key, or of those kinds that are asked for; some are valid, most not."""
    k = F.col("o_orderkey")
    pan = F.concat(_letter(k), _letter(k * 3), _letter(k * 5), F.substring(F.lit("PCHFATBLJGXZ"), (k % 12 + 1).cast("int"), 1), _letter(k * 7), _digits(k * 13, 4), _letter(k * 11))
    kinds = {
        "aadhaar": F.concat(_digits(k % 8 + 2, 1), _digits(k * 7919, 11)),
        "card": F.concat(F.lit("4"), _digits(k * 104729, 15)),
        "pan": pan,
        "ifsc": F.concat(_letter(k), _letter(k * 3), _letter(k * 5), _letter(k * 7), F.when(k % 4 == 0, F.lit("1")).otherwise(F.lit("0")), _digits(k * 31, 6)),
        "mobile": F.concat(F.when(k % 3 == 0, F.lit("+91 ")).otherwise(F.lit("")), _digits(k % 10, 1), _digits(k * 17, 9)),
        "passport": F.concat(_letter(k), _digits(k * 19, 7)),
        "gstin": F.concat(_digits(k % 50, 2), pan, _digits(k, 1), F.lit("Z"), _digits(k * 3, 1)),
        "vehicle": F.concat(_letter(k), _letter(k * 3), F.lit("-"), _digits(k, 2), F.lit("-"), _letter(k * 5), _letter(k * 7), F.lit(" "), _digits(k * 23, 4)),
        "secret": F.concat(_letter(k), F.lower(_letter(k * 3)), _digits(k * 29, 5), F.lower(_letter(k * 5)), _digits(k * 37, 5), _letter(k * 7), F.lower(_letter(k * 9)), _digits(k, 3)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in kinds.items() if not only or n in only])
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey")).select(k.alias("k"), F.inline(rows))


ID_CANDIDATES_SQL = """
  SELECT o_orderkey AS k, kind, value FROM (
    SELECT o_orderkey, chr((65 + o_orderkey % 26)::INT) AS l1, chr((65 + o_orderkey * 3 % 26)::INT) AS l3, chr((65 + o_orderkey * 5 % 26)::INT) AS l5,
           chr((65 + o_orderkey * 7 % 26)::INT) AS l7, chr((65 + o_orderkey * 9 % 26)::INT) AS l9, chr((65 + o_orderkey * 11 % 26)::INT) AS l11,
           substr('PCHFATBLJGXZ', (o_orderkey % 12 + 1)::INT, 1) AS holder FROM orders),
  LATERAL (VALUES
    ('aadhaar', (o_orderkey % 8 + 2)::VARCHAR || lpad((o_orderkey * 7919 % 100000000000)::VARCHAR, 11, '0')),
    ('card', '4' || lpad((o_orderkey * 104729 % 1000000000000000)::VARCHAR, 15, '0')),
    ('pan', l1 || l3 || l5 || holder || l7 || lpad((o_orderkey * 13 % 10000)::VARCHAR, 4, '0') || l11),
    ('ifsc', l1 || l3 || l5 || l7 || CASE WHEN o_orderkey % 4 = 0 THEN '1' ELSE '0' END || lpad((o_orderkey * 31 % 1000000)::VARCHAR, 6, '0')),
    ('mobile', CASE WHEN o_orderkey % 3 = 0 THEN '+91 ' ELSE '' END || (o_orderkey % 10)::VARCHAR || lpad((o_orderkey * 17 % 1000000000)::VARCHAR, 9, '0')),
    ('passport', l1 || lpad((o_orderkey * 19 % 10000000)::VARCHAR, 7, '0')),
    ('gstin', lpad((o_orderkey % 50)::VARCHAR, 2, '0') || l1 || l3 || l5 || holder || l7 || lpad((o_orderkey * 13 % 10000)::VARCHAR, 4, '0') || l11 || (o_orderkey % 10)::VARCHAR || 'Z' || (o_orderkey * 3 % 10)::VARCHAR),
    ('vehicle', l1 || l3 || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-' || l5 || l7 || ' ' || lpad((o_orderkey * 23 % 10000)::VARCHAR, 4, '0')),
    ('secret', l1 || lower(l3) || lpad((o_orderkey * 29 % 100000)::VARCHAR, 5, '0') || lower(l5) || lpad((o_orderkey * 37 % 100000)::VARCHAR, 5, '0') || l7 || lower(l9) || lpad((o_orderkey % 1000)::VARCHAR, 3, '0'))
  ) AS t(kind, value)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, n, mode, r): whole-number rectangles by line item on a 1280 x 800 page."""
    x, y = F.col("l_partkey") % 1280, (F.col("l_suppkey") * 8) % 800
    w, h = F.col("l_quantity").cast("int") * 4, 16 + 4 * F.col("l_linenumber")
    mode = F.when(F.col("l_returnflag") == "A", "mask_solid").when(F.col("l_returnflag") == "N", "placeholder").otherwise("blur")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n"), mode.alias("mode"), rect(x, y, w, h).alias("r"))


RECTS_SQL = """
  SELECT l_orderkey AS page_id, l_linenumber AS n,
         CASE l_returnflag WHEN 'A' THEN 'mask_solid' WHEN 'N' THEN 'placeholder' ELSE 'blur' END AS mode,
         (l_partkey % 1280)::DOUBLE AS x, (l_suppkey * 8 % 800)::DOUBLE AS y, (l_quantity::INT * 4)::DOUBLE AS w, (16 + 4 * l_linenumber)::DOUBLE AS h
  FROM lineitem"""


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, text): a sentence around each derived identifier, with and without its label."""
    label = F.create_map(*[F.lit(v) for p in LABELS.items() for v in p])
    return id_candidates(spark, sf_dir).select(
        (F.col("k") * 16 + F.array_position(F.array(*map(F.lit, LABELS)), F.col("kind"))).alias("k"),
        F.concat(F.lit("Été: "), F.when(F.col("k") % 2 == 0, label[F.col("kind")]).otherwise(F.lit("ref")), F.lit(" = "), F.col("value"), F.lit(", see https://U:p@Shop.example.com:8443/a?b=1. done")).alias("text"),
    )


#: Words before a derived identifier in ``labelled_texts``.
LABELS = {
    "aadhaar": "uid", "card": "bank card", "pan": "pan", "ifsc": "ifsc", "mobile": "phone", "passport": "passport", "gstin": "roll no",
    "vehicle": "otp", "secret": "access token",
}
LABELLED_SQL = (
    "SELECT k * 16 + list_position([" + ", ".join(f"'{n}'" for n in LABELS) + "], kind) AS k, 'Été: ' || CASE WHEN k % 2 = 0 THEN CASE kind "
    + " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in LABELS.items())
    + f" END ELSE 'ref' END || ' = ' || value || ', see https://U:p@Shop.example.com:8443/a?b=1. done' AS text FROM ({ID_CANDIDATES_SQL})"
)
