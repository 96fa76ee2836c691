"""Queries that run as streams over all events there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loops as batch
from ..sources.derived import table
from ..streaming import stateful
from .loops import ORACLE as _LOOPS
from .registry import Registry

query = Registry()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern serves a file as well as a folder


@query(_LOOPS["repeat_tiers"])
def streamed_repeat_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeat tiers from state kept by run; the same rows as the batch form's."""
    k, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "click", "click").when(t == "view", "scroll").when(t == "purchase", "type").when(t == "signup", "goto_url").otherwise("noop")
    rows = _events(spark, sf_dir).select(
        F.col("user_id").alias("run"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_id", batch.signature(kind, k % 20 % 3).alias("sign"),
        (k % 2).cast("string").alias("state"), F.expr("event_id div 40 % 5").cast("string").alias("place"),
    )
    return stateful.drained(stateful.repeat_tiers(rows), "tiers")


@query("""
  WITH e AS (SELECT event_type, date_trunc('day', ts) AS d FROM events)
  SELECT event_type, epoch_us(d::TIMESTAMP) // 1000 AS day, count(*) AS n FROM e WHERE d < (SELECT max(d) FROM e) GROUP BY event_type, d""")
def streamed_daily_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by kind and day behind a watermark: the last, unfinished day is held back."""
    rows = _events(spark, sf_dir).select("event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "0 seconds")
    out = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.unix_millis("window.start").alias("day"), "n")
    return stateful.drained(out, "daily")


QUERIES, ORACLE = query.queries, query.oracle
