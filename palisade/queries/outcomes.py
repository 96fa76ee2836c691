"""Queries over observations of pages, one after another. A user's events are the steps; what a page shows after each of
them follows from the user, the number of the step and the event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import outcome
from ..sources.derived import spread, table
from .registry import Registry

query = Registry()

NODES = 8
_PRESENT = "(run + (version // 3) * (node + 1)) % 4 <> 0"
_STEPS = """
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_id,
         CASE event_type WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'type' WHEN 'signup' THEN 'select' WHEN 'error' THEN 'goto_url' ELSE 'click' END AS kind, event_id % 6 AS typed
  FROM events"""
_ELEMENTS = f"""
  SELECT run, version, version // 7 AS document, node, node AS n, event_id,
         CASE node WHEN 6 THEN 'alert' WHEN 7 THEN 'status' ELSE 'textbox' END AS role, 'e' || node AS name,
         CASE node WHEN 6 THEN 'message ' || version // 4 % 5 WHEN 7 THEN 'mail a' || version // 6 || '@b.org' END AS text,
         node < 6 AND (event_id + node * 7) % 23 = 0 AS invalid, CASE WHEN node < 5 THEN 'wrong value ' || node END AS message
  FROM s, (SELECT unnest(range({NODES})) AS node) WHERE {_PRESENT}"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, version, event_id, kind, submits, place, typed): the events of a user in order."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "scroll", "purchase", "type", "signup", "select", "error", "goto_url")])
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), version.alias("version"), "event_id", F.coalesce(F.element_at(kind, F.col("event_type")), F.lit("click")).alias("kind"))
    own = F.when(F.col("kind") == "type", F.array((F.col("event_id") % 6).cast("long"))).otherwise(F.array().cast("array<long>"))
    return rows.withColumns({"submits": F.col("kind") == "type", "place": F.concat(F.lit("/p/"), F.expr("version div 5").cast("string")), "typed": own})


def observed(rows: DataFrame) -> DataFrame:
    """Elements after each of ``steps``."""
    node, number = F.col("node"), lambda e: F.expr(e).cast("string")
    every = spread(rows).select("run", "version", "event_id", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1)).cast("array<long>")).alias("node"))
    return every.where("(run + (version div 3) * (node + 1)) % 4 <> 0").select(
        "run", "version", F.expr("version div 7").alias("document"), "node", node.alias("n"), F.when(node == 6, "alert").when(node == 7, "status").otherwise("textbox").alias("role"),
        F.concat(F.lit("e"), node.cast("string")).alias("name"),
        F.when(node == 6, F.concat(F.lit("message "), number("version div 4 % 5"))).when(node == 7, F.concat(F.lit("mail a"), number("version div 6"), F.lit("@b.org"))).alias("text"),
        ((node < 6) & ((F.col("event_id") + node * 7) % 23 == 0)).alias("invalid"), F.when(node < 5, F.concat(F.lit("wrong value "), node.cast("string"))).alias("message"),
    )


@query(f"""
  WITH s AS ({_STEPS}), e AS ({_ELEMENTS}),
  g AS (
    SELECT a.run, a.version, a.document, count(*) AS live,
           count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.run = a.run AND b.document = a.document AND b.node = a.node AND b.version < a.version)) AS minted,
           count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e b WHERE b.run = a.run AND b.document = a.document AND b.node = a.node AND b.version < a.version - 1)
                              AND NOT EXISTS (SELECT 1 FROM e b WHERE b.run = a.run AND b.document = a.document AND b.node = a.node AND b.version = a.version - 1)) AS returned
    FROM e a GROUP BY ALL)
  SELECT g.run, g.version, live, minted, returned,
         (SELECT count(*) FROM e p WHERE p.run = g.run AND p.document = g.document AND p.version = g.version - 1
            AND NOT EXISTS (SELECT 1 FROM e c WHERE c.run = g.run AND c.version = g.version AND c.document = g.document AND c.node = p.node)) AS dropped
  FROM g""")
def element_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each observation: elements, new ones, returned ones, and how many left."""
    return outcome.registry(observed(steps(spark, sf_dir)))


_IDS = f"""
  s AS ({_STEPS}), raw AS ({_ELEMENTS}),
  first AS (SELECT run, document, node, min(version * 100 + n) AS rank FROM raw GROUP BY ALL),
  ids AS (SELECT run, document, node, 'el_' || (row_number() OVER (PARTITION BY run, document ORDER BY rank, node) - 1) AS element_id FROM first),
  e AS (SELECT raw.*, element_id FROM raw JOIN ids USING (run, document, node))"""


@query(f"""
  WITH {_IDS},
  fresh AS (SELECT c.*, s.kind = 'type' AND s.typed = c.node AS touched FROM e c JOIN s USING (run, version) WHERE c.invalid
              AND NOT EXISTS (SELECT 1 FROM e p WHERE p.run = c.run AND p.version = c.version - 1 AND p.element_id = c.element_id AND p.invalid)),
  culprit AS (SELECT run, version, arg_min(element_id, CASE WHEN touched THEN n ELSE 100 + n END) AS element_id, arg_min(coalesce(message, ''), CASE WHEN touched THEN n ELSE 100 + n END) AS reason FROM fresh GROUP BY ALL),
  notice AS (SELECT run, version, arg_min(text, n) AS notice FROM e c WHERE role IN ('alert', 'status')
               AND NOT EXISTS (SELECT 1 FROM e p WHERE p.run = c.run AND p.version = c.version - 1 AND p.role IN ('alert', 'status') AND p.text = c.text) GROUP BY ALL),
  shape AS (SELECT run, version, string_agg(n || element_id || role || name, ',' ORDER BY n) AS shape FROM e GROUP BY ALL),
  f AS (
    SELECT s.run, s.version, s.kind AS action, culprit.element_id, reason, notice,
           s.version > 1 AS later, a.shape IS NOT DISTINCT FROM b.shape AND s.version // 5 = (s.version - 1) // 5 AND s.kind <> 'select' AS still
    FROM s LEFT JOIN culprit USING (run, version) LEFT JOIN notice USING (run, version)
    LEFT JOIN shape a ON a.run = s.run AND a.version = s.version LEFT JOIN shape b ON b.run = s.run AND b.version = s.version - 1),
  k AS (SELECT *, CASE WHEN NOT later THEN NULL WHEN element_id IS NOT NULL THEN 'refused' WHEN notice IS NOT NULL THEN 'message' WHEN still AND action = 'scroll' THEN 'end' WHEN still THEN 'unchanged' END AS kind FROM f)
  SELECT run, version, kind, action, CASE WHEN kind = 'refused' THEN element_id END AS element_id,
         CASE kind WHEN 'refused' THEN nullif(reason, '') WHEN 'message' THEN notice END AS said,
         CASE kind WHEN 'refused' THEN 'the page refused ' || element_id WHEN 'message' THEN 'the page showed a new message'
                   WHEN 'end' THEN 'the page would not scroll any further' WHEN 'unchanged' THEN 'the last action changed nothing' END AS note
  FROM k""")
def step_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each user did to the page."""
    rows = steps(spark, sf_dir)
    return outcome.outcomes(observed(rows), rows)


@query()
def step_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about steps that achieved nothing, with what the page said sanitised (tests hold the sentences)."""
    rows = steps(spark, sf_dir)
    return outcome.hinted(outcome.outcomes(observed(rows), rows)).where("kind is not null")


QUERIES, ORACLE = query.queries, query.oracle
