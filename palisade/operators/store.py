"""Stored values and routes as tables: upserts, site binding, catalogues, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Routes kept by site, steps of a route, least share of words that recalls one.
MOST_ROUTES, MOST_STEPS, LEAST_OVERLAP = 40, 24, 0.5


def upserted(entries: DataFrame, keys: list[str], at: str, used: str) -> DataFrame:
    """Entries by key: the latest values, the first creation, every site they were used on."""
    rest = [c for c in entries.columns if c not in (*keys, at, used)]
    return entries.groupBy(*keys).agg(
        F.min(at).alias("created_at"), F.max(at).alias("updated_at"), *[F.max_by(c, at).alias(c) for c in rest], F.sort_array(F.collect_set(used)).alias("used_on")
    )


def token(pii_type: Column, slot: Column) -> Column:
    return F.upper(F.concat_ws("_", pii_type, slot))


def next_slots(entries: DataFrame, order: str) -> DataFrame:
    """Adds slot: the type without underscores and its number by order."""
    nth = F.row_number().over(Window.partitionBy("pii_type").orderBy(order))
    return entries.withColumn("slot", F.concat(F.replace("pii_type", F.lit("_"), F.lit("")), nth))


def goal_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the fewer words; 0 if one has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def latest(routes: DataFrame) -> DataFrame:
    """Of routes that share site and words only the latest: each site's rows shrink to
    its different goals, so that joins by site do not grow with the square of a site."""
    words = routes.select("origin", "route", "saved_at", goal_words(F.col("goal")).alias("w"))
    return words.groupBy("origin", "w").agg(F.max(F.struct("saved_at", "route")).alias("l")).select("origin", F.col("w").alias("rw"), "l.saved_at", "l.route")


def recalled(asked: DataFrame, routes: DataFrame) -> DataFrame:
    """asked (k, origin, goal) with the route (route, origin, goal, saved_at) of the same
    site that shares most words, half at least; of equals the latest."""
    both = asked.select("k", "origin", goal_words(F.col("goal")).alias("w")).join(latest(routes), "origin").withColumn("share", overlap(F.col("w"), F.col("rw")))
    return both.where(F.col("share") >= LEAST_OVERLAP).groupBy("k").agg(F.max_by(F.struct("route", "share"), F.struct("share", "saved_at", "route")).alias("b")).select("k", "b.route", "b.share")


def remembered(routes: DataFrame) -> DataFrame:
    """Routes without earlier ones of the same site with a similar goal; the latest
    MOST_ROUTES, of MOST_STEPS steps at most."""
    a, b = routes.withColumn("w", goal_words(F.col("goal"))).alias("a"), latest(routes).alias("b")
    later = (F.col("a.origin") == F.col("b.origin")) & (F.col("b.saved_at") > F.col("a.saved_at")) & (overlap(F.col("a.w"), F.col("b.rw")) >= LEAST_OVERLAP)
    left = a.join(b, later, "left_anti")
    nth = F.row_number().over(Window.orderBy(F.desc("saved_at"), "route"))
    return left.orderBy(F.desc("saved_at"), "route").limit(MOST_ROUTES).select("route", "origin", "saved_at", F.least(F.col("steps"), F.lit(MOST_STEPS)).alias("steps")).withColumn("place", nth)


def passphrase_problem(p: Column) -> Column:
    return (
        F.when(F.length(p) < 10, "short").when(p.rlike(r"\A[0-9]+\z"), "digits")
        .when(F.size(F.array_distinct(F.split(p, ""))) < 5, "few_characters")
    )
