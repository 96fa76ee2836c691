"""Packing documents into sequences by bounded-space online best-fit.

Documents are encoded and cut where they are. Pieces of the full length are sequences of their own.
The others are packed by tasks that get only (key, length) of so many pieces each: every piece goes
at once into the open sequence that it fills best. At most ``most`` sequences are open: they are
keyed by their free space in a bitset, where the lowest set bit at or above a length is the best
fit. If none fits and no more may be open, the fullest one closes. A task looks ahead over
``LOOKAHEAD`` pieces and places the longest of them first.

What is still open when a task ends is handed on: the open sequences of ``FAN`` tasks, each moved as
a whole, are packed by the same rule, and so on until one group is left. So no task holds
more than a bounded number of sequences, and no more than one group's are left unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, map_batches

#: Sequences that are open at once.
OPEN = 4096
#: Pieces that a task packs, and of these that it orders by length before it places them.
PER_TASK, LOOKAHEAD = 1 << 18, 1024
#: Tasks whose open sequences are packed together.
FAN = 32
#: Ids that one output batch holds, but for a single longer text.
_IDS = 1 << 20


class OpenBins:
    """At most ``most`` open bins of ``size`` places, found by their free space."""

    def __init__(self, size: int, most: int, first: int = 0):
        self.size, self.most, self.next, self.n = size, most, first, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.free = 0  # bit f: some open bin has f places left

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.free ^= 1 << free
        self.n -= 1
        return found

    def put(self, length: int, name: int | None = None) -> tuple[int, int]:
        """The bin and the place there of something of this length. A new bin is called ``name``, or
        by the next number."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.size, self.new() if name is None else name
            if self.n == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.free |= 1 << left
            self.n += 1
        return found, self.size - free

    def still_open(self) -> Iterator[tuple[int, int]]:
        """(bin, places taken)"""
        return ((b, self.size - free) for free, held in enumerate(self.by_free) for b in held)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE vocabulary whose
    ids are in the order of its merges: the compiled byte-pair encoder takes the ids as ranks. Other
    vocabularies, and texts at which that encoder gives up, go through the merge rounds of ``bpe``."""

    def __init__(self, path: str):
        self.table, self.cache = bpe._loaded(path)
        special = {c: i for c, i in self.table.added.items()}
        ranks = {b: i for i, b in enumerate(self.table.bytes_of) if b and i not in set(special.values())}
        ordered = bool((np.diff(self.table.merged[np.argsort(self.table.ranks)]) > 0).all())
        self.fast = tiktoken.Encoding(f"own-{path}", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens=special) if ordered else None

    def _rounds(self, text: str) -> np.ndarray:
        cut = self.table.pieces(text)
        self.cache.ready([cut])
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, cut)), "<i4").astype("<u4")
        self.cache.done()
        return ids

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None:
            return self._rounds(text)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the pattern's backtracking has a limit, which ends in a panic of its library
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return self._rounds(text)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cut(tokenizer: str, end_id: int, size: int, with_ids: bool):
    """Rows (id, text) -> a row a piece; key numbers the pieces."""
    names = ["id", "piece", "start", "length", "ids_crc32", "key", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), np.array([end_id], "<u4")
        key = TaskContext.get().partitionId() << 40

        def batch(rows: list[tuple], doc: list[int], ids_of: pa.Array) -> pa.RecordBatch:
            nonlocal key
            piece, start, length, crc, ids = zip(*rows, strict=True)
            cols = [ids_of.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            cols.append(pa.array(np.arange(key, key + len(rows))))
            key += len(rows)
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            rows, doc, held = [], [], 0
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4", copy=False)
                data, n = memoryview(ids).cast("B"), len(ids)
                at, piece, stop = 0, 0, n % size or size  # the first piece may be shorter, all others are full
                while at < n:
                    rows.append((piece, at, stop - at, zlib.crc32(data[4 * at : 4 * stop]), ids[at:stop] if with_ids else None))
                    doc.append(k)
                    at, stop, piece = stop, stop + size, piece + 1
                held += n
                if held > _IDS:
                    yield batch(rows, doc, b.column(0))
                    rows, doc, held = [], [], 0
            if rows:
                yield batch(rows, doc, b.column(0))

    return run


def _pack(size: int, most: int):
    """Rows (key, length) -> key, bin, offset, taken: the place of each piece; at the end a row
    without key for each bin that is still open, with its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, most, TaskContext.get().partitionId() << 40)
        names = ["key", "bin", "offset", "taken"]
        for b in batches:
            for at in range(0, b.num_rows, LOOKAHEAD):
                part = b.slice(at, LOOKAHEAD)
                order = np.argsort(-part.column(1).to_numpy(), kind="stable")
                put = np.array([bins.put(n) for n in part.column(1).to_numpy()[order].tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(order)), pa.array(put[:, 0]), pa.array(put[:, 1]), pa.nulls(len(order), pa.int64())], names=names)
        left = np.array(list(bins.still_open()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(left), pa.int64()), pa.array(left[:, 0]), pa.array(left[:, 1] * 0), pa.array(left[:, 1])], names=names)

    return run


def _merged(size: int, most: int):
    """Open bins (bin, taken) of a group -> (bin, head, shift, taken): each bin that moves with
    the bin and place it moves to; each that is open at the end with its length."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bins, group, out = OpenBins(size, most), int(rows["group"].iloc[0]), []
        rows = rows.sort_values(["taken", "bin"], ascending=[False, True])
        for b, taken in zip(rows["bin"].tolist(), rows["taken"].tolist(), strict=True):
            head, shift = bins.put(taken, b)
            if head != b:
                out.append((group, b, head, shift, 0))
        out += [(group, b, b, 0, n) for b, n in bins.still_open()]
        return pd.DataFrame(out, columns=["group", "bin", "head", "shift", "taken"])

    return run


def packed(
    docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, most: int = OPEN, fan: int = FAN, ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id_col, piece (from 0), start (ids of its document before it), length,
    ids_crc32 (of its ids as little-endian uint32), sequence_id, offset (its place there; gapless from
    0) and, if asked, ids.

    A document is its text's ids and ``end_id``; a null text is empty, so that its document is the
    end alone. Only documents of over ``size`` ids are cut. Repeated rows and null ids are
    documents like any other; other columns are not read; an empty table gives no rows. Sequence
    numbers may differ from run to run, as rows come to tasks in another order.
    """
    if size < 1 or most < 1 or fan < 2:
        raise ValueError("size and most are at least 1, fan at least 2")
    scratch = Scratch(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, key long" + ", ids array<int>" * ids
    pieces = scratch.written(map_batches(rows, _cut(tokenizer, end_id, size, ids), schema), "pieces", keep=True)
    short = pieces.where(F.col("length") < size).select("key", "length")
    tasks = -(-short.count() // PER_TASK)
    placed = short.repartition(max(1, tasks), "key").mapInArrow(_pack(size, most), "key long, bin long, offset long, taken long")
    placed = scratch.written(placed, "places")
    moves = _handed_on(placed.where("key is null").select(F.shiftright("bin", 40).alias("group"), "bin", "taken"), scratch, size, most, fan)
    places = placed.where("key is not null").join(moves, "bin", "left").select(
        "key", F.coalesce("head", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
    places = scratch.written(places, "final-places", keep=True)
    scratch.clear()
    full = pieces.where(F.col("length") >= size).withColumns({"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")})
    return pieces.where(F.col("length") < size).join(places, "key").unionByName(full).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * ids
    )


def _handed_on(left: DataFrame, scratch: Scratch, size: int, most: int, fan: int) -> DataFrame:
    """left: group, bin, taken of the bins that tasks left open -> bin, head, shift of those that
    move into another. Groups of ``fan`` are packed until one is left."""
    moves = None
    while True:
        last = left.agg(F.max("group")).first()[0] or 0
        grouped = left.select(F.floor(F.col("group") / fan).alias("group"), "bin", "taken")
        step = scratch.written(grouped.groupBy("group").applyInPandas(_merged(size, most), "group long, bin long, head long, shift long, taken long"), "open-sequences")
        own = step.where("bin <> head").select("bin", "head", "shift")
        if moves is not None:  # what moved before moves on with its head
            on = own.select(F.col("bin").alias("head"), F.col("head").alias("to"), F.col("shift").alias("by"))
            own = own.unionByName(moves.join(on, "head", "left").select("bin", F.coalesce("to", "head").alias("head"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")))
        moves, left = own, step.where("bin = head").select("group", "bin", "taken")
        if last < fan:
            return moves


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (all of it), starts (where each piece begins) of the rows that ``packed`` gives
    with ids. A sequence is bounded, so is what a group holds."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(held.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))
