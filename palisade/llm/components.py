"""Connected components with DataFrame operations alone.

Large-star and small-star contraction (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): each round links every vertex to the least vertex
it knows of, so that the edges shrink to stars in a logarithmic number of rounds.
The number of edges never grows. The least neighbour is a partial aggregation; it
is joined back to the edges, a join that Spark can split where a vertex is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.join(least, "u").where("v > u and v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: v < u. Links the least v of each u to u and to its other v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (vertex, root) for every vertex of ``edges`` (columns u, v; one type)
    but the roots themselves; root is the least vertex that it can reach.

    Loops and repeated edges count once; edges with a null end are left out; no
    edges give no rows. Each round is written to the shared folder, so its lineage is
    short and it survives lost executors; the round before it is deleted.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.written(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(), "edges"
    )
    seen = _signature(now)
    while seen[0]:
        after = scratch.written(_small_star(_large_star(now)), "edges")
        scratch.drop(now)
        now, before, seen = after, seen, _signature(after)
        if before == seen:
            break
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
