"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share a budget of words by weight; a target stops at
``max_copies`` times its source's size and what is over goes to the others by weight,
until none is above. That fixpoint has a closed form: with the sources in order of
limit over weight, the first few stand at their limits and the rest share what is
left by weight.

Copies: a source with target / size = r takes floor(r) whole copies of each document
for certain. The rest, r - floor(r) of its words, is a sample of fixed size in words with
unequal probabilities: a document's inclusion probability p is proportional to its size
(to twelve bits), and those that this would bring to one are taken for certain. Each
document gets the ranking number (u / (1 - u)) / (p / (1 - p)), u its own random
number (Rosen, "On Sampling with Probability Proportional to Size", 1997), and the
documents with the least numbers are taken as long as their words fit the rest; then one
more, whose size comes nearest to what is missing. u is a hash of the id and the text, so
reruns agree.

The cut in a source's order is found without sorting a source in one task: the ranking
numbers fall into ``BINS`` bins by u, the sizes of bins are pre-aggregated sums, and
only the bin in which the budget runs out is ordered row by row, itself cut by finer
bins first. So a source with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bins of the ranking number at each of the two levels.
BINS = 4096
#: A table of one row a source is broadcast up to so many rows, and else copied to so many salts.
SMALL, SALTS = 20_000, 32


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: float = 3.0, share: float = 1.0) -> DataFrame:
    """sizes: (source, source_size). Adds target. Weights repeat along the sources in
    order of code points, the null source last. One row a source; the windows are over
    the table of sources, not of documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.select("source", "source_size", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")).alias("weight"))
    by_limit = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    limit = F.col("source_size") * max_copies
    level = w.select(
        "*", F.row_number().over(by_limit).alias("k"), limit.alias("limit"), (F.sum("source_size").over(everything) * share).alias("budget"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum(limit).over(before), F.lit(0.0)).alias("limits_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weights_before"),
    ).withColumn("level", (F.col("budget") - F.col("limits_before")) / (F.col("weights") - F.col("weights_before")))
    # the first source whose limit isn't exceeded if it and those after it share what is left
    free = F.col("level") * F.col("weight") <= F.col("limit")
    final = F.min(F.when(free, F.struct("k", "level"))).over(everything)["level"]
    return level.withColumn("final", final).select(
        "source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("final") * F.col("weight"), F.col("limit"))).alias("target")
    )


def _uniform(h: Column) -> Column:
    """A number in (0, 1) from a 64-bit hash."""
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def _weight(size: Column) -> Column:
    """A size to its first twelve bits, so that a source has some 40,000 different ones at most."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(size.cast("double") + 0.5)).cast("int") - 11)
    return F.when(size < 4096, size).otherwise(F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)).cast("long")


def _rates(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """By source (s): __c, which times its weight is a document's inclusion probability. Weights from
    the heaviest down are certain as long as the others' share would bring the next above one."""
    cells = narrow.groupBy("source", _weight(F.col("size")).alias("w")).agg(F.sum("size").alias("words"))
    cells = _with_source(cells.where("w > 0"), goals)
    down = Window.partitionBy("__source").orderBy(F.desc("w"))
    certain = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum(F.col("words") * F.col("w")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = cells.select("__source", "w", (F.greatest(F.lit(0.0), F.col("__rest") - certain) / free).alias("c")).where("c * w <= 1")
    return level.groupBy("__source").agg(F.max_by("c", "w").alias("__c")).withColumnRenamed("__source", "s")


def _with_source(table: DataFrame, small: DataFrame, key: str = "__source", how: str = "inner") -> DataFrame:
    """table (source) joined with a table of one row a source. That one is broadcast if it has
    ``SMALL`` rows at most; else it is copied to ``SALTS`` salts, over which a hot source's rows are spread."""
    if small.count() <= SMALL:
        return table.join(F.broadcast(small), table["source"].eqNullSafe(small[key]), how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = table.withColumn("__mine", F.floor(F.rand(3) * SALTS).cast("int"))
    return spread.join(salted, spread["source"].eqNullSafe(salted[key]) & (spread["__mine"] == salted["__salt"]), how).drop("__salt", "__mine")


def mixed(
    docs: DataFrame,
    size: Column,
    weights: tuple[float, ...] = (1, 2, 3),
    max_copies: int = 3,
    share: float = 1.0,
    odds: Column | None = None,
    key: Column | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with __size, __source_size, __target, __copies: how often the mix takes
    each row (columns of these names are replaced). ``odds`` multiplies a document's odds of
    the sampled copy (null: 1). ``key``: what the random numbers are a hash of, instead of id
    and text.

    The null source is a source of its own. Rows of size 0 are taken floor(r) times
    and move no total. Rows equal in id and text stand or fall together. An empty table
    gives no rows; null ids and texts are hashed like any value.
    """
    h = F.xxhash64(F.lit(seed), key) if key is not None else F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(f"`{source_col}`").alias("source"), size.cast("long").alias("size"), h.alias("h"), (odds if odds is not None else F.lit(1.0)).alias("o"))
    # texts are read twice: for this narrow table, over which all is decided, and for the result
    narrow = written(rows.select("source", "size", "h", "o"), "mixing")
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = targets(sums, weights, max_copies, share).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), rate.alias("__rate")
    )
    # a source's share of the budget; rates a hair below a whole number are that number
    whole = F.floor(F.col("__rate") + 1e-9)
    goals = written(goals.withColumns({
        "__whole": whole.cast("int"), "__rest": F.greatest(F.lit(0.0), F.col("__target") - whole * F.col("__source_size")),
    }), "mixing-goals")
    rates = _rates(narrow, goals)
    goals = written(goals.join(rates, goals["__source"].eqNullSafe(rates["s"]), "left").drop("s").fillna(0.0, ["__c"]), "mixing-rates")

    def placed(table: DataFrame) -> DataFrame:
        """With each row's place in its source's order, in [0, 1), and its bins."""
        u = _uniform(F.col("h"))
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("__c") * _weight(F.col("size"))))
        number = (u / (1 - u)) / (p / (1 - p) * F.coalesce("o", F.lit(1.0)))
        out = _with_source(table, goals).withColumn("place", number / (1 + number))
        return out.withColumns({"bin": F.floor(F.col("place") * BINS).cast("int"), "fine": (F.floor(F.col("place") * BINS * BINS) % BINS).cast("int")})

    def cut(table: DataFrame, bin_col: str) -> DataFrame:
        """By source: the first bin in which the words taken so far reach the rest, and the words before it."""
        sums = table.groupBy("source", bin_col).agg(F.sum("size").alias("n"), F.first("__rest").alias("rest"))
        run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy(bin_col)))
        first = F.min(F.struct(F.col(bin_col).alias("bin"), (F.col("upto") - F.col("n")).alias("before"))).alias("c")
        return run.where("upto >= rest").groupBy("source").agg(first).select("source", "c.*")

    light = placed(narrow).select("source", "size", "__rest", "bin", "fine", "place", "h")
    first = written(cut(light, "bin").select(F.col("source").alias("s1"), F.col("bin").alias("cut"), F.col("before").alias("b1")), "mixing-cut")
    inside = _with_source(light, first, "s1").where("bin = cut").withColumn("__rest", F.col("__rest") - F.col("b1")).drop("s1", "cut", "b1")
    second = written(cut(inside, "fine").select(F.col("source").alias("s2"), F.col("bin").alias("fcut"), F.col("before").alias("b2")), "mixing-cut")
    last = _with_source(inside, second, "s2").where("fine = fcut").withColumn("__rest", F.col("__rest") - F.col("b2"))
    # what is left is ordered: BINS^2 times fewer rows than the source has, but for the certain ones
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("place", "h"))
    taken = last.withColumn("upto", upto).where("upto <= __rest")
    # the last place taken in the crossing bins; places before them are all taken
    edge = taken.groupBy("source").agg(F.max(F.struct("place", "h")).alias("e"), F.max("upto").alias("b3"))
    edge = edge.select(F.col("source").alias("s3"), F.col("e.place").alias("edge"), F.col("e.h").alias("edge_h"), "b3")
    marks = (
        first.join(second, first["s1"].eqNullSafe(second["s2"]), "left").join(edge, first["s1"].eqNullSafe(edge["s3"]), "left")
        .select(
            F.col("s1").alias("s"), "cut", "fcut", F.coalesce("edge", F.lit(-1.0)).alias("edge"), F.coalesce("edge_h", F.lit(0)).alias("edge_h"),
            (F.col("b1") + F.coalesce("b2", F.lit(0)) + F.coalesce("b3", F.lit(0))).alias("used"),
        )
    )
    place = lambda p, h: F.struct(F.col(p).alias("p"), F.col(h).alias("h"))
    within = (
        F.col("cut").isNull()  # the whole source doesn't fill the rest
        | (F.col("bin") < F.col("cut"))
        | ((F.col("bin") == F.col("cut")) & (F.col("fine") < F.col("fcut")))
        | ((F.col("bin") == F.col("cut")) & (F.col("fine") == F.col("fcut")) & (place("place", "h") <= place("edge", "edge_h")))
    )
    # one more document whose size comes nearest to what is missing, if that helps
    marks = written(marks, "mixing-marks")
    gap = F.col("__rest") - F.col("used")
    beyond = _with_source(light, marks, "s").where(~within & (F.col("__rest") > 0) & (F.abs(gap - F.col("size")) < gap))
    fill = beyond.groupBy("source").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "place", "h")).alias("f"))
    fill = fill.select(F.col("source").alias("s4"), F.col("f.place").alias("fill"), F.col("f.h").alias("fill_h"))
    marks = written(marks.join(fill, marks["s"].eqNullSafe(fill["s4"]), "left").drop("s4"), "mixing-fill")
    out = _with_source(placed(rows), marks, "s", "left")
    extra = F.when((F.col("__rest") > 0) & (F.col("__whole") < max_copies) & (within | place("place", "h").eqNullSafe(place("fill", "fill_h"))), F.lit(1)).otherwise(F.lit(0))
    added = {"__size": F.col("size"), "__source_size": F.col("__source_size"), "__target": F.col("__target"), "__copies": (F.col("__whole") + extra).cast("int")}
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def repeated(docs: DataFrame, size: Column, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it."""
    own = docs.columns
    found = mixed(docs, size, **how).where("__copies > 0")
    return found.select(*[F.col(f"`{c}`") for c in own], F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__k")).drop("__k")
