"""Queries over action streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import loops
from ..sources.derived import table
from .registry import Registry
from .replies import ACTIONS_SQL, proposed

query = Registry()

# the default window hardly ever fires on these events (two a user and day), so a wide one is asked, too
_WIDE_MS, _WIDE_LIMIT = 6 * 3600 * 1000, 3


def _rate_sql(window: int, limit: int) -> str:
    return f"""
  WITH a AS ({ACTIONS_SQL}), n AS (SELECT event_id, count(*) OVER (PARTITION BY run ORDER BY at_ms RANGE BETWEEN {window} PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY run, at_ms) + row_number() OVER (PARTITION BY run, at_ms ORDER BY event_id) - 1 AS recent FROM a)
  SELECT event_id, recent, recent >= {limit} AS limited FROM n"""


@query(_rate_sql(10_000, 60))
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier actions within ten seconds, and whether the default limit refuses."""
    return loops.rate(proposed(spark, sf_dir), "run", "at_ms").select("event_id", "recent", "limited")


@query(_rate_sql(_WIDE_MS, _WIDE_LIMIT))
def rate_limit_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over six hours with a limit of three."""
    return loops.rate(proposed(spark, sf_dir), "run", "at_ms", _WIDE_MS, _WIDE_LIMIT).select("event_id", "recent", "limited")


@query(f"""
  WITH a AS (SELECT *, type || '|' || target % 3 AS sign, (event_id % 2)::VARCHAR AS state, event_id // 40 % 5 AS place FROM ({ACTIONS_SQL})),
  m AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY run ORDER BY at_ms, event_id) <> place, false) AS moved FROM a),
  v AS (SELECT *, sum(moved::INT) OVER (PARTITION BY run ORDER BY at_ms, event_id)::BIGINT AS visit FROM m),
  c AS (SELECT *, count(*) OVER (PARTITION BY run, sign, state ORDER BY at_ms, event_id) AS here, count(*) OVER (PARTITION BY run, visit, sign ORDER BY at_ms, event_id) AS there FROM v)
  SELECT event_id, moved, visit, here, there, CASE WHEN here > 3 OR there > 6 THEN 'stop' WHEN here = 3 OR there = 6 THEN 'skip' WHEN here >= 2 OR there >= 3 THEN 'hint' ELSE 'go' END AS tier FROM c""")
def repeat_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of a proposal in one state and during one stay, and what they lead to."""
    rows = loops.repeats(
        proposed(spark, sf_dir), "run", ["at_ms", "event_id"], loops.signature(F.col("type"), F.col("target") % 3), (F.col("event_id") % 2).cast("string"),
        F.expr("event_id div 40 % 5"),
    )
    return rows.select("event_id", "moved", "visit", "here", "there", "tier")


@query(f"""
  SELECT event_id, CASE type WHEN 'type' THEN CASE WHEN event_id % 2 = 0 THEN 2500 ELSE 400 END WHEN 'click' THEN 1500 WHEN 'scroll' THEN 400 ELSE 150 END AS settle_ms,
         type IN ('click', 'goto_url', 'scroll') OR type = 'type' AND event_id % 2 = 0 AS expects_change, type IN ('stop', 'request_user_input') AS terminal,
         type NOT IN ('noop', 'scroll') AS mutates, CASE WHEN type IN ('click', 'type', 'scroll') THEN target END AS target FROM ({ACTIONS_SQL})""")
def action_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of action it is: settling time, expected change, target."""
    t, submits = F.col("type"), F.col("event_id") % 2 == 0
    return proposed(spark, sf_dir).select(
        "event_id", loops.settle_budget(t, submits).alias("settle_ms"), loops.expects_change(t, submits).alias("expects_change"), t.isin("stop", "request_user_input").alias("terminal"),
        (~t.isin("noop", "scroll")).alias("mutates"), F.when(t.isin("click", "type", "scroll"), F.col("target")).alias("target"),
    )


@query(f"""
  WITH a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY at_ms DESC, event_id DESC) AS back FROM ({ACTIONS_SQL}))
  SELECT run, string_agg(type, '>' ORDER BY at_ms, event_id) FILTER (WHERE back <= 8) AS tail, arg_max(type, struct_pack(a := at_ms, e := event_id)) AS last FROM a GROUP BY run""")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight actions of each run in order, and the last one."""
    back = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("at_ms"), F.desc("event_id")))
    rows = proposed(spark, sf_dir).withColumn("back", back)
    kept = F.sort_array(F.collect_list(F.when(F.col("back") <= loops.HISTORY, F.struct("at_ms", "event_id", "type"))))
    return rows.groupBy("run").agg(F.array_join(F.transform(kept, lambda x: x["type"]), ">").alias("tail"), F.max_by("type", F.struct("at_ms", "event_id")).alias("last"))


@query(f"""
  WITH a AS ({ACTIONS_SQL}), b AS (SELECT run, at_ms // 86400000 AS day, event_id, target, lag(target) OVER (PARTITION BY run ORDER BY at_ms, event_id) AS was FROM a)
  SELECT run, day, min(event_id) FILTER (WHERE target > 16) AS first_failing, count(*) FILTER (WHERE was IS DISTINCT FROM target) AS changes FROM b GROUP BY ALL""")
def step_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By run and day: the first failing step of the sequence, and steps that differ from the one before."""
    was = F.lag("target").over(Window.partitionBy("run").orderBy("at_ms", "event_id"))
    rows = proposed(spark, sf_dir).withColumn("was", was).withColumn("day", F.expr("at_ms div 86400000"))
    return rows.groupBy("run", "day").agg(F.min(F.when(F.col("target") > 16, F.col("event_id"))).alias("first_failing"), F.count_if(~F.col("was").eqNullSafe(F.col("target"))).alias("changes"))


@query("""
  WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stay FROM g)
  SELECT user_id, epoch_us(min(ts)) // 1000 AS begin, epoch_us(max(ts) + INTERVAL 6 HOUR) // 1000 AS finish, count(*) AS n FROM s GROUP BY user_id, stay""")
def quiet_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a user's events with no gap of six hours: settling as a session window."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return loops.quiet_periods(events, "user_id", "ts", "6 hours").select("user_id", F.unix_millis("begin").alias("begin"), F.unix_millis("finish").alias("finish"), "n")


QUERIES, ORACLE = query.queries, query.oracle
