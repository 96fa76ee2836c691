"""Even shards that keep linked documents together, by balanced label propagation.

Documents with equal texts are linked. Each starts in a shard given by a hash. In a
round, the documents of a group look at where their neighbours are and want to move to
the fullest of the group's shards that has room; a shard takes movers up to its quota,
largest gain first. Documents of one group in one shard are alike, so a round works on
the table of (group, shard, documents), never on pairs, and only on groups with links.

The law is `rows`: counts of shards are at most one apart. After the last round all
documents are ranked by (label, group, id) and the ranking is cut into equal runs. A
cut parts one group at most, so beside groups larger than a shard at most one group a
boundary is parted. Ranks come from range partitions and their counts, so a group with
a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

ROUNDS = 4
#: A shard's quota is shared by so many independent takers, which decide in parallel.
TAKERS = 16


def positions(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` with their rank from 0 in this order (ties in any order), without
    bringing them together: ranks within range partitions plus the counts before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = written(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parted.withColumn(name, rank.cast("long")).join(offsets, "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def propagate(cells: DataFrame, quota: Column, rounds: int = ROUNDS) -> DataFrame:
    """cells: (grp, shard, n), the linked documents; returns them after the rounds.
    quota: documents that a shard may hold, over the column shard."""
    now = cells
    for _ in range(rounds):
        loads = now.groupBy("shard").agg(F.sum("n").alias("held"))
        room = loads.select("shard", F.greatest(F.lit(0), quota - F.col("held")).alias("room"))
        seen = now.join(room, "shard")
        goal = seen.where("room > 0").groupBy("grp").agg(F.max_by(F.struct("shard", "room", "n"), F.struct(F.col("n"), -F.col("shard"))).alias("to"))
        wants = (
            now.join(goal, "grp").where((F.col("shard") != F.col("to.shard")) & (F.col("n") <= F.col("to.n")))
            .select("grp", "shard", "n", F.col("to.shard").alias("dest"), F.col("to.room").alias("room"), F.col("to.n").alias("gain"))
            .withColumn("taker", F.pmod(F.xxhash64("grp", "shard"), F.lit(TAKERS)))
        )
        line = Window.partitionBy("dest", "taker").orderBy(F.desc("gain"), "grp", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        share = F.floor((F.col("room") + F.col("taker")) / TAKERS)  # the takers' shares add up to the room
        moves = wants.withColumn("before", F.sum("n").over(line) - F.col("n")).withColumn(
            "moved", F.greatest(F.lit(0), F.least(F.col("n"), share - F.col("before")))
        ).where("moved > 0")
        moves = moves.select(F.inline(F.array(
            F.struct("grp", "shard", (-F.col("moved")).alias("n")), F.struct("grp", F.col("dest").alias("shard"), F.col("moved").alias("n"))
        )))
        now = cut(now.unionByName(moves).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return now


def sharded(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, size (UTF-8 bytes of the text plus 16),
    text_crc32, shard, slot (its place in the shard, gapless from 0), group_rows (rows
    with its text).

    Null texts count as empty and are a group with the empty ones. Null ids rank
    first; repeated rows are placed each for itself. An empty table gives no rows, and
    with fewer rows than shards some shards stay empty. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("grp"),
    ), "shard-rows")
    total = rows.count()
    start = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(shards)).cast("int")
    cells = rows.groupBy("grp", start.alias("shard")).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("grp").agg(F.sum("n").alias("group_rows")).where("group_rows > 1")
    linked = cut(cells.join(sizes.select("grp"), "grp"))
    # rows before each shard's end, as the final cut has them
    edge = lambda k: F.floor(k * (total / shards))
    quota = edge(F.col("shard") + 1) - edge(F.col("shard"))
    final = propagate(linked, quota, rounds)
    # by group: its shards and, running, the documents in them (an entry a shard at most)
    upto = Window.partitionBy("grp").orderBy("shard")
    plan = final.withColumn("upto", F.sum("n").over(upto)).groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("plan"), F.sum("n").alias("group_rows")
    )
    known = rows.join(plan, "grp", "left")
    alone = known.where("plan is null").select("id", "size", "crc", "grp", F.lit(1).cast("long").alias("group_rows"), start.alias("label"))
    together = positions(known.where("plan is not null").drop("plan"), ["grp", "id"])
    firsts = together.groupBy("grp").agg(F.min("pos").alias("first"))
    nth = F.col("pos") - F.col("first")
    placed = together.join(firsts, "grp").join(plan.select("grp", "plan"), "grp").select(
        "id", "size", "crc", "grp", "group_rows", F.get(F.filter("plan", lambda p: p["upto"] > nth), F.lit(0))["shard"].alias("label")
    )
    ranked = positions(alone.unionByName(placed), ["label", "grp", "id"])
    # integer arithmetic: the largest k with floor(k * total / shards) <= pos
    shard = f"((pos + 1) * {shards} - 1) div {max(total, 1)}L"
    return ranked.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.expr(shard).cast("int").alias("shard"),
        F.expr(f"pos - ({shard}) * {total}L div {shards}").alias("slot"), "group_rows",
    )
