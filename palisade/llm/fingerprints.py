"""Document fingerprints by content-defined chunking.

A gear hash rolls over the text's UTF-8 bytes (each step shifts the hash and adds the
byte's fixed random number, so it depends on the last 32 bytes alone). A chunk ends
where the hash has zeros under a mask: a stricter mask before the normal size, a
looser one after it, so that sizes gather around it; no chunk is smaller or larger
than the limits. Boundaries follow the content, so an insertion moves only the chunks
around it. The fingerprint is the set of chunk digests with their lengths, and the
likeness of A to B is the share of A's length whose chunks B has, too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

LEAST, NORMAL, MOST = 16, 64, 255
#: Zeros that a boundary needs among the hash's top bits before and after the normal size.
STRICT, LOOSE = np.uint32(0xFF000000), np.uint32(0xF0000000)
#: A random number for each byte, from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, np.uint32)
#: Hex digits of a chunk: ten of its digest, two of its length.
_WIDTH = 12


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling: sums over 1, 2, 4 ... 32 bytes."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] += h[:-step] << np.uint32(step)
    return h


def boundaries(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``."""
    n = len(data)
    if not n:
        return []
    h = rolling(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0].tolist()
    loose = loose.tolist()
    ends, at = [], 0
    while n - at > LEAST:
        k = bisect_left(strict, at + LEAST - 1)
        if k < len(strict) and strict[k] < at + NORMAL - 1:
            end = strict[k] + 1
        else:
            k = bisect_left(loose, at + NORMAL - 1)
            end = loose[k] + 1 if k < len(loose) and loose[k] < at + MOST else at + MOST
        if end >= n:
            break
        ends.append(end)
        at = end
    ends.append(n)
    return ends


def chunks(data: bytes) -> dict[str, int]:
    """Digest and length (hex) of each different chunk -> its length."""
    out, at = {}, 0
    for end in boundaries(data):
        piece = data[at:end]
        out[f"{xxhash.xxh64_intdigest(piece) >> 24:010x}{end - at:02x}"] = end - at
        at = end
    return out


def text_of(found: dict[str, int]) -> str:
    return "".join(sorted(found))


def parse(fingerprint: str) -> dict[str, int]:
    return {c: int(c[-2:], 16) for c in (fingerprint[k : k + _WIDTH] for k in range(0, len(fingerprint), _WIDTH))}


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of a's length whose chunks b has; of an empty one: 1 if b is empty, else 0."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for c, n in a.items() if c in b) / sum(a.values())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col and fingerprint, a string that equal texts
    share. Null texts are empty and have an empty one. A table without rows gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([text_of(chunks((t or "").encode())) for t in b.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"]
            )

    kind = dict(docs.dtypes)[id_col]
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def _long(x: int | None) -> Column:
    return F.lit(x).cast("long")


def _int(x: int | None) -> Column:
    return F.lit(x).cast("int")


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are no larger than the value, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    own = F.array(*map(_long, cuts))

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(cuts)) & (F.get(own, at + by - 1) <= value), at + by).otherwise(at)

    return F.aggregate(F.array(*map(_int, steps)), F.lit(0), step)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents dealt out by range of id, each range followed by a copy of the first
    document of the next one (the last by the first of all): id, text, part, extra.

    Ranges are cut at quantiles of the ids; the driver holds their bounds and first
    ids, one for each partition. The text is shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts = own.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    # the null ids come first, in range 0
    part = _range_of(F.coalesce("id", F.lit(-(1 << 63))), cuts)
    heads = own.select("id", part.alias("part")).groupBy("part").agg(
        F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("null")
    ).orderBy("part").collect()
    firsts = [(None if h["null"] else h["id"], h["part"]) for h in heads]
    # by range: its first id, and the range before it, whose last document that one follows
    first: list = [None] * (len(cuts) + 1)
    before: list = [None] * (len(cuts) + 1)
    for k, (i, p) in enumerate(firsts):
        first[p], before[p] = i, firsts[k - 1][1]
    rows = own.withColumn("part", part).select(
        "id", "text", "part",
        F.when(F.col("id").eqNullSafe(F.get(F.array(*map(_long, first)), F.col("part"))), F.get(F.array(*map(_int, before)), F.col("part"))).alias("to"),
    )
    here = F.struct("part", F.lit(False).alias("extra"))
    there = F.struct(F.col("to").alias("part"), F.lit(True).alias("extra"))
    rows = rows.select("id", "text", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("at"))
    rows = rows.select("id", "text", "at.part", "at.extra")
    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "extra", "id", "text")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the start of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_chars, edited (text), fingerprint,
    edited_fingerprint, near_edited, near_next. The next document is the next in
    ascending id order (null ids first; equal ids by text), after the last the first.

    Null texts are empty. Of repeated rows each is a document of its own; a single
    document follows itself; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document before, which waits for the next one
        for b in batches:
            out = []
            for doc_id, text, part, extra in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                text = text or ""
                found = None if held is None or held[2] != part else chunks(text.encode())
                if found is not None:
                    was, was_text, _, was_found = held
                    changed = edited(was_text, text)
                    new = chunks(changed.encode())
                    out.append((was, len(was_text), changed, text_of(was_found), text_of(new), containment(was_found, new), containment(was_found, found)))
                held = None if extra else (doc_id, text, part, found if found is not None else chunks(text.encode()))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=NAMES)

    NAMES = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = map_batches(
        with_next(docs, id_col, text_col).select("id", "text", "part", "extra"), run,
        "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
    return rows.withColumnRenamed("id", id_col)
