r"""SimHash near-duplicate groups by bit-sliced comparison, and groups by exact similarity.

The pipeline keeps one document of each near-duplicate group by exact shingle similarity
(``keep_one``, ``similar_links``). The rest of this module is about fingerprints.

A document's fingerprint has bit b set if over half of the hashes of its word shingles
have it: 64 bits of XXH64 (seed 42), or a multiple of 128 bits of XXH3. Fingerprints at
a Hamming distance up to ``radius`` are linked; a component is what links reach.

How links are found without comparing all pairs:

1. Equal fingerprints collapse to one row, so copies cost nothing further.
2. Each fingerprint is filed under several keys, each a part of its bits. With 64 bits
   and a small radius the bits fall into ``radius + 2`` blocks, and a key is a pair of
   blocks: two fingerprints within the radius agree in two blocks at least, so none is
   missed (``block_masks``). Wide fingerprints with a large radius, as a similarity of
   0.8 asks for, are filed under ``SAMPLED`` keys of ``SAMPLED_BITS`` bits drawn at
   random, of which similar fingerprints share one with high probability (``sampled_masks``).
3. Keys with one fingerprint are dropped by a count. A key with over ``TILE``
   fingerprints is cut into tiles, and each pair of tiles is compared by itself, so
   no task holds an unbounded key.
4. Within a key, 64 fingerprints stand in one machine word per bit plane. A query's
   distance to 64 others grows by one XOR a plane, added with carry-save counters;
   a block whose 64 lanes all exceed the radius is abandoned.
5. A task returns a spanning forest of each key's links, never its pairs. Connected
   components over these edges are DataFrame joins (``components``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, pieces, written
from .components import components
from .hashing import bit_counts, hashes, majorities, mixed, once

SEED = 42
#: Fingerprints of one key that one task compares at once, for a pair of tiles twice as many.
TILE = 4096
#: Keys of a wide fingerprint and bits of each. Of pairs whose bits differ at a rate of
#: 0.15 (similarity 0.8) a key keeps one in 19, so that 48 keys find nine in ten. They are
#: no guarantee; ``similar_links`` is complete.
SAMPLED, SAMPLED_BITS = 48, 18
#: Rows that are compared at once (numpy calls are dear for fewer).
_ROWS = 1 << 14
#: Hashes whose bits are counted at once.
_COUNTED = 255 << 7
#: Words of the fingerprints in front of exact similarity, and their radius: sets at a similarity of
#: 0.8 differ in 39 of 256 bits (standard deviation 6), unlike ones in 128.
_WIDE, RADIUS = 4, 68
#: So many sets of a key that stay alone are compared with a centre of their own before they are with each other.
_ALONE, _ROUNDS = 64, 8
#: Sets that a task remembers so as to file equal ones once.
_SEEN = 1 << 19


def fingerprint(text: str | None, shingle: int, bits: int = 64) -> np.ndarray:
    """The words (uint64) of one text's fingerprint; without words all bits are 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only \x20 \x09-\x0D
    if not words:
        return np.zeros(bits // 64, np.uint64)
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(bits, np.int64)
    for at in range(0, n, _COUNTED):
        part = words[at : at + _COUNTED + shingle - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if n > 1 or len(words) == shingle else [b" ".join(words)]
        if bits == 64:
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)[:, None]
        else:
            wide = xxhash.xxh3_128_digest
            if bits == 256:
                data = b"".join([wide(s, SEED) + wide(s, SEED + 1) for s in shingles])
            else:
                data = b"".join([wide(s, SEED + k) for s in shingles for k in range(bits // 128)])
            hashes = np.frombuffer(data, "<u8").reshape(-1, bits // 64)
        for k in range(bits // 64):
            total[64 * k : 64 * k + 64] += bit_counts(hashes[:, k])
    return np.packbits(2 * total > n, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, shingle: int = 5, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, f0, f1 ...): the fingerprint of every whole text as signed longs. A null
    or wordless text has 0; fewer words than a shingle count as one shingle."""
    words = bits // 64
    if bits != 64 and bits % 128:
        raise ValueError("a fingerprint has 64 bits or a multiple of 128")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, bits) for t in b.column(1).to_pylist()], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(words))], names=["id", *names(words)])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind}, " + ", ".join(f"{c} long" for c in names(words)))


def names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def block_masks(radius: int) -> list[list[int]]:
    """For each key the bits that it takes of the only word: pairs of radius + 2 blocks."""
    n = radius + 2
    edges = [64 * k // n for k in range(n + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [[x | y] for x, y in combinations(block, 2)]


def sampled_masks(bits: int, keys: int = SAMPLED, key_bits: int = SAMPLED_BITS) -> list[list[int]]:
    """For each key the bits that it takes of each word, drawn with a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    out = []
    for _ in range(keys):
        chosen = rng.permutation(bits)[:key_bits].tolist()
        out.append([sum(1 << (b % 64) for b in chosen if b // 64 == w) for w in range(bits // 64)])
    return out


def within_run(fps: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bit-sliced distances. fps: uint64 (rows, words), rows of a run together; row i's
    run is [start[i], end[i]). Yields (rows, words, masks): bit k of a mask says that row
    64 * word + k is of the row's run, later than it, and within the radius."""
    n, width = fps.shape
    n_words = -(-n // 64)
    padded = np.zeros((n_words * 64, width), "<u8")
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T.reshape(64 * width, n_words, 64), axis=2, bitorder="little")).view("<u8").reshape(64 * width, n_words)
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    row = np.arange(n)
    step = 0
    while True:
        word = row // 64 + step
        live = np.flatnonzero(word * 64 < end) if step else np.flatnonzero(row + 1 < end)
        if not len(live):
            return
        for at in range(0, len(live), 1 << 16):
            rows = live[at : at + (1 << 16)]
            w = rows // 64 + step
            low = np.maximum(rows + 1, w * 64) - w * 64
            high = np.minimum(end[rows], w * 64 + 64) - w * 64
            some = low < high
            rows, w, low, high = rows[some], w[some], low[some].astype(np.uint64), high[some].astype(np.uint64)
            valid = (full >> (np.uint64(64) - high)) & (full << low)
            query = fps[rows]
            # counters[c]: bit c of each lane's distance; over: lanes beyond the radius
            counters = [np.zeros(len(rows), np.uint64) for _ in range((radius + 1).bit_length())]
            over = ~valid
            for b in range(64 * width):
                carry = planes[b][w] ^ (np.uint64(0) - ((query[:, b // 64] >> np.uint64(b % 64)) & one))
                for c in range(len(counters)):
                    counters[c], carry = counters[c] ^ carry, counters[c] & carry
                over |= carry
                if b % 8 == 7:
                    over |= _above(counters, radius)
                    keep = np.flatnonzero(over != full)
                    if len(keep) * 4 < len(rows) * 3:  # the others' blocks are abandoned
                        rows, w, query, over = rows[keep], w[keep], query[keep], over[keep]
                        counters = [c[keep] for c in counters]
                if not len(rows):
                    break
            if len(rows):
                hit = over != full
                if hit.any():
                    yield rows[hit], w[hit], ~over[hit]
        step += 1


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius, by comparing from the top bit down."""
    above, equal = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    for c in reversed(range(len(counters))):
        if radius >> c & 1:
            equal = equal & counters[c]
        else:
            above = above | (equal & counters[c])
            equal = equal & ~counters[c]
    return above | np.zeros_like(counters[0])


def _forest(fps: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) for rows that are not the root of their component within the run.
    Masks are walked in row order; a component's lanes leave later masks as soon as
    they are reached, so a dense run costs its masks, not its pairs."""
    n = len(fps)
    by_row: dict[int, list[tuple[int, int]]] = {}
    for rows, words, masks in within_run(fps, start, end, radius):
        for r, w, m in zip(rows.tolist(), words.tolist(), masks.tolist(), strict=False):
            by_row.setdefault(r, []).append((w, m))
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    joined: dict[tuple[int, int], int] = {}  # (root, word): lanes known to be of that root's component
    for r in sorted(by_row):
        root = find(r)
        for w, m in by_row[r]:
            todo = m & ~joined.get((root, w), 0)
            while todo:
                k = (todo & -todo).bit_length() - 1
                todo &= todo - 1
                other = find(64 * w + k)
                if other != root:
                    root, other = min(root, other), max(root, other)
                    parent[other] = root
            joined[root, w] = joined.get((root, w), 0) | m
    roots = np.array([find(x) for x in range(n)]) if by_row else parent
    rows = np.flatnonzero(roots != np.arange(n))
    return rows, roots[rows]


def _link_runs(radius: int, words: int):
    """Over rows (key, vertex, words) sorted by key: edges (u, v) of each key's forest."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, vertex = (rows.column(k).to_numpy() for k in range(2))
        fps = np.stack([rows.column(2 + k).to_numpy() for k in range(words)], axis=1).view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        lengths = np.diff(np.concatenate([starts, [len(key)]]))
        start, end = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
        at, roots = _forest(fps, start, end, radius)
        return pa.RecordBatch.from_arrays([pa.array(vertex[at]), pa.array(vertex[roots])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < _ROWS:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column(0).to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if whole:
                yield links(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            n -= whole
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def links(distinct: DataFrame, words: int, radius: int, masks: list[list[int]], tile: int = TILE) -> DataFrame:
    """Edges (u, v) between the vertices of ``distinct`` (vertex, f0 ...; no repeats):
    those of each key's spanning forest, which connect what all pairs under one key at
    up to ``radius`` differing bits would connect."""
    own = names(words)

    def key(k: int, mask: list[int]):
        parts = [F.col(c).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for c, m in zip(own, mask, strict=True) if m]
        return F.xxhash64(F.lit(k), *parts)

    # one exchange of (key, vertex) serves the counts and the join with them; words follow for keys that are shared
    filed = distinct.select("vertex", F.explode(F.array(*[key(k, m) for k, m in enumerate(masks)])).alias("key")).repartition("key")
    counts = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = filed.join(counts, "key").select("key", "vertex", F.ceil(F.col("n") / tile).alias("tiles")).join(distinct, "vertex")
    held = shared.select(
        "vertex", *own, F.explode(F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
            lambda other: F.xxhash64("key", F.least(other, F.pmod(F.xxhash64("vertex"), F.col("tiles"))), F.greatest(other, F.pmod(F.xxhash64("vertex"), F.col("tiles")))),
        )).alias("key")
    )
    held = held.repartition("key").sortWithinPartitions("key")
    return map_batches(held.select("key", "vertex", *own), _link_runs(radius, words), "u long, v long")


def near_duplicates(
    docs: DataFrame, radius: int = 3, shingle: int = 5, bits: int = 64, masks: list[list[int]] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id_col, f0 ... (the fingerprint's longs) and
    component_id, the least id of the fingerprints that links reach from its own.

    Null and wordless texts have fingerprint 0 and are linked like any other. A null
    id is grouped like any other and never the least unless all ids of its component
    are null. Repeated rows give repeated rows; an empty table gives none. Other
    columns are not read.
    """
    words = bits // 64
    own = names(words)
    masks = masks or (block_masks(radius) if bits == 64 else sampled_masks(bits))
    vertex = F.col("f0") if words == 1 else F.xxhash64(*own)
    fps = written(fingerprints(docs, shingle, bits, id_col, text_col).withColumn("vertex", vertex), "simhash")
    least = fps.groupBy("vertex", *own).agg(F.min("id").alias("least"))
    roots = components(links(least.select("vertex", *own), words, radius, masks))
    classes = least.join(roots, "vertex", "left").select("vertex", "least", F.coalesce("root", "vertex").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = classes.join(named, "root").select("vertex", "component_id")
    return fps.join(of, "vertex").select(F.col("id").alias(id_col), *own, "component_id")


def hexed(fp: str = "f0"):
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """Two sets of that Jaccard similarity share at least one of so many least members
    of each, under any order of the members that is the same for both."""
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


class ShingleSets:
    """The different shingles of each text of a batch as sorted hashes: ``hashes``, ``text`` (of
    each hash), ``n`` (hashes of each text), ``start``. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in
    lower case; texts with fewer words than a shingle have one shingle, wordless ones none."""

    def __init__(self, texts: pa.Array, shingle: int):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = pc.list_flatten(parts)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        text = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(parts)))
        there = offsets[1:] > offsets[:-1]
        text, word = text[there], hashes(data, offsets[:-1], offsets[1:])[there]
        n = np.bincount(text, minlength=len(texts))
        total = np.zeros(len(word), np.uint64)
        for k in range(min(shingle, len(word))):  # of a short text all words count
            part = word[k:]
            total[: len(part)] += np.where(text[k:] == text[: len(part)], mixed(part + np.uint64(k)) * np.uint64(2 * k + 1), np.uint64(0))
        place = np.arange(len(word)) - (np.cumsum(n) - n)[text]
        some = place < np.maximum(1, n - shingle + 1)[text]
        text, total = text[some], mixed(total[some])
        order = np.lexsort((total, text))
        text, total = text[order], total[order]
        new = np.ones(len(total), bool)
        new[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
        self.text, self.hashes = text[new], total[new]
        self.n = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)])

    def vertices(self) -> np.ndarray:
        """A hash (int64) of each set."""
        data, at, digest = memoryview(self.hashes.tobytes()), (8 * self.start).tolist(), xxhash.xxh3_64_intdigest
        return np.array([digest(data[a:b], SEED) - (1 << 63) for a, b in zip(at, at[1:], strict=False)], np.int64)

    def fingerprints(self, words: int) -> np.ndarray:
        """(texts, words) int64: each set's SimHash."""
        out = np.zeros((len(self.n), words), np.int64)
        some = np.flatnonzero(self.n)
        for k in range(words if len(some) else 0):
            out[some, k] = majorities(mixed(self.hashes + np.uint64(k)), self.start[some], self.n[some])
        return out

    def members(self, count: np.ndarray, only: np.ndarray) -> pa.ListArray:
        """The first ``count`` hashes of each text, of those that ``only`` names."""
        count = np.where(only, count, 0)
        place = np.arange(len(self.hashes)) - self.start[self.text]
        ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(self.hashes[place < count[self.text]].view(np.int64)))


def shingle_sets(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """rows (row, text) -> row, vertex (hash of the set), n (its size), a fingerprint, and once a task
    for equal sets the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in pieces(batches):
            sets = ShingleSets(b.column(1), shingle)
            vertex, prints, new = sets.vertices(), sets.fingerprints(_WIDE), np.zeros(b.num_rows, bool)
            for k, v in enumerate(vertex.tolist()):
                if v not in seen:
                    seen.add(v)
                    new[k] = True
            if len(seen) > _SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(vertex), pa.array(sets.n.astype(np.int32)), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(_WIDE)),
                sets.members(prefix_length(sets.n, similarity), new),
            ], names=["row", "vertex", "n", *names(_WIDE), "prefix"])

    return map_batches(rows, run, "row long, vertex long, n int, " + ", ".join(f"{c} long" for c in names(_WIDE)) + ", prefix array<long>")


def _whole_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rows (text) -> vertex, hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = ShingleSets(b.column(0), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(sets.vertices()), sets.members(sets.n, sets.n >= 0)], names=["vertex", "hashes"])

    return map_batches(rows, run, "vertex long, hashes array<long>")


def _in_runs(judged):
    """Over rows sorted by key and vertex: judged(columns) of whole keys, without rows that repeat
    the (key, vertex) before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, enough = 0, _ROWS
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
                n += b.num_rows
            if n < enough:
                continue
            cols = once([np.concatenate(c) for c in zip(*held, strict=True)])
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
            if last:
                yield from judged([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
            n = len(held[0][0])
            enough = max(_ROWS, 2 * n)
        if n:
            yield from judged(once([np.concatenate(c) for c in zip(*held, strict=True)]))

    return run


def _shared_runs(most: int):
    """Over rows (key, vertex) sorted by both: those of keys with two vertices or more. The new key is a hash of
    the key's vertices: keys with the same ones would be compared in the same way, and become one. A key of over
    ``most`` rows is ``big`` and keeps its name; it passes through in parts that share it."""

    def part(key: np.ndarray, vertex: np.ndarray, big: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(vertex), pa.array(np.full(len(key), big))], names=["key", "vertex", "big"])

    def small(key: np.ndarray, vertex: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        length = np.diff(np.concatenate([starts, [len(key)]]))
        sums = np.add.reduceat(mixed(vertex.view(np.uint64)), starts)
        many = np.repeat(length > 1, length)
        if many.any():
            yield part(np.repeat(mixed(sums), length)[many], vertex[many], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, going_on = 0, None  # the big key whose rows go on

        def judged(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, going_on
            key, vertex = once([np.concatenate(c) for c in zip(*held, strict=True)])
            while len(key):
                ends = int(np.searchsorted(key, key[0], "right"))
                if key[0] == going_on or ends > most:
                    going_on = key[0]
                    yield part(mixed(~key[:ends].view(np.uint64)), vertex[:ends], True)
                    key, vertex = key[ends:], vertex[ends:]
                    continue
                starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
                large = np.flatnonzero(np.diff(starts) > most)
                ends = int(starts[large[0]] if len(large) else starts[-1] if final else starts[-2])
                if not ends:
                    break  # the last key may go on
                yield from small(key[:ends], vertex[:ends])
                key, vertex = key[ends:], vertex[ends:]
            held = [[key, vertex]]
            n = len(key)

        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
                n += b.num_rows
            if n >= max(_ROWS, 2 * most):
                yield from judged(False)
        if n:
            yield from judged(True)

    return run


def _near_runs(radius: int, similarity: float):
    """Rows (key, vertex, n, words): those near their key's central row u (``near``), or near another
    row but u (``more``), by bit-sliced comparison of all rows of the key."""

    def judged(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, vertex, n = cols[:3]
        fps = np.stack(cols[3:], axis=1).view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        length = np.diff(np.concatenate([starts, [len(key)]]))
        start, end = np.repeat(starts, length), np.repeat(starts + length, length)
        # the row nearest to the bits that most of the key's rows have
        off = np.arange(len(key))
        run = np.repeat(np.arange(len(starts)), length)
        for k in range(fps.shape[1]):
            off = off + (np.bitwise_count(fps[:, k] ^ majorities(fps[:, k].copy(), starts, length).view(np.uint64)[run]).astype(np.int64) << 32)
        centre = (np.minimum.reduceat(off, starts) & 0xFFFFFFFF)[run]
        like = lambda a, b: np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * similarity - 1e-9
        row = np.arange(len(key))
        apart = sum(np.bitwise_count(fps[:, k] ^ fps[centre, k]).astype(np.int64) for k in range(fps.shape[1]))
        near = (row != centre) & (apart <= radius) & like(row, centre)
        hits = np.zeros(-(-len(key) // 64), np.uint64)  # by word of 64 rows: near another row but the centre
        one = np.uint64(1)
        for rows, words, masks in within_run(fps, start, end, radius):
            c = centre[rows]
            masks = np.where(c // 64 == words, masks & ~(one << (c % 64).astype(np.uint64)), masks)
            some = (rows != c) & (masks != 0)
            np.bitwise_or.at(hits, words[some], masks[some])
            np.bitwise_or.at(hits, rows[some] // 64, one << (rows[some] % 64).astype(np.uint64))
        more = np.unpackbits(hits.astype("<u8").view(np.uint8), bitorder="little")[: len(key)].astype(bool)
        out = near | more
        if out.any():
            columns = [key, vertex, n, *cols[3:], vertex[centre], near, more]
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns], names=["key", "v", "n", *names(fps.shape[1]), "u", "near", "more"])

    return judged


def _paired(big: DataFrame, tile: int) -> DataFrame:
    """big: distinct (key, vertex) of keys with too many vertices for one task. Rows (key, vertex) under
    keys of at most two tiles of about ``tile`` vertices, such that any two vertices of a key meet. Of keys
    with the same vertices one is left."""
    sets = big.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("vertex").cast("decimal(38,0)")).alias("s"))
    sets = sets.groupBy("n", "s").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / tile).cast("long").alias("tiles"))
    own = F.pmod(F.xxhash64("vertex"), F.col("tiles"))
    pair = lambda other: F.xxhash64("key", F.least(other, own), F.greatest(other, own))
    tiles = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    return big.join(sets, "key").select(F.explode(F.transform(tiles, pair)).alias("key"), "vertex")


def similar_components(rows: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, shingle: int, radius: int, tile: int = TILE) -> DataFrame:
    """Rows (vertex, root) of the components that all pairs of exact Jaccard similarity
    ``similarity`` or more make of the vertices of ``sets`` (``shingle_sets`` of ``rows``).

    Similar sets share a member of their prefixes (``prefix_length``), so a set is filed
    under each of its own. A key with over ``tile`` sets is cut into tiles, and each two of its tiles
    are a key. Under a key, sets are compared by their fingerprints, bit-sliced;
    those within the radius are verified by their whole sets. To spare the pairs of a large
    group, a key's sets are first verified against its central one; while many of a key's sets stay
    alone, these are verified against a central one of their own; and only then
    sets in different components against the rest of their key.
    """
    own = names(_WIDE)
    filed = sets.select(F.explode("prefix").alias("key"), "vertex")
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "vertex")
    runs = scratch.written(map_batches(by_key(filed), _shared_runs(tile), "key long, vertex long, big boolean"), "shared-shingles")
    runs = scratch.written(runs.dropDuplicates(["key", "vertex"]), "shared-once")
    tiled = _paired(runs.where("big").select("key", "vertex"), tile)
    prints = sets.where(F.size("prefix") > 0).select("vertex", "n", *own).dropDuplicates(["vertex"])
    held = runs.where("not big").select("key", "vertex").unionByName(tiled).join(prints, "vertex").select("key", "vertex", "n", *own)
    marks = "key long, v long, n int, " + ", ".join(f"{c} long" for c in own) + ", u long, near boolean, more boolean"
    marked = scratch.written(by_key(held).mapInArrow(_in_runs(_near_runs(radius, similarity)), marks), "near-sets")
    if marked.isEmpty():  # no text is shuffled for nothing
        return components(marked.select("u", "v"))
    ends = marked.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    asked = sets.join(ends, "vertex", "left_semi").groupBy("vertex").agg(F.min("row").alias("row")).select("row")
    whole = scratch.written(_whole_sets(rows.join(asked, "row", "left_semi").dropDuplicates(["row"]).select("text"), shingle), "whole-sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
        side = lambda v, h: whole.select(F.col("vertex").alias(v), F.col("hashes").alias(h))
        both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
        common = F.size(F.array_intersect("a", "b"))
        return scratch.written(both.where(common >= (F.size("a") + F.size("b") - common) * similarity - 1e-9).select("u", "v"), f"{name}-similar")

    def classed(roots: DataFrame) -> DataFrame:
        of = lambda v, name: roots.select(F.col("vertex").alias(v), F.col("root").alias(name))
        named = marked.where("more").join(of("v", "c"), "v", "left").join(of("u", "cu"), "u", "left")
        return scratch.written(named.select("key", "v", "n", *own, F.coalesce("c", "v").alias("c"), F.coalesce("cu", "u").alias("cu")), "set-classes")

    edges = verified(marked.where("near"), "set-pairs")
    roots = components(edges)
    named = classed(roots)
    for _ in range(_ROUNDS):  # each links the groups around new centres; what is left after them goes on as it is
        linked = roots.select(F.col("root").alias("v")).distinct()
        alone = named.where("c = v and c <> cu").join(linked, "v", "left_anti")
        crowded = alone.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") >= _ALONE).select("key")
        crowd = alone.join(crowded, "key", "left_semi").select("key", F.col("v").alias("vertex"), "n", *own)
        around = scratch.written(by_key(crowd).mapInArrow(_in_runs(_near_runs(radius, similarity)), marks).where("near").select("u", "v"), "centres")
        if around.isEmpty():
            break
        more = verified(around, "set-pairs-alone")
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
        roots = components(edges)
        named = classed(roots)
    out = named.where("c <> cu").select("key", F.col("v").alias("x"), F.col("c").alias("cx"), *[F.col(c).alias("x" + c) for c in ("n", *own)])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col("x" + c))) for c in own), F.lit(0))
    near = (apart <= radius) & (F.least("n", "xn") >= F.greatest("n", "xn") * similarity - 1e-9)
    rest = named.join(out, "key").where((F.col("c") != F.col("cx")) & ((F.col("c") == F.col("cu")) | (F.col("v") < F.col("x"))) & near)
    more = verified(rest.select(F.col("v").alias("u"), F.col("x").alias("v")), "set-pairs-2")
    return roots if more.isEmpty() else components(edges.unionByName(more))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the row with the least id (null
    last), of equal ids the one with the least hash; rows equal in id and text leave one, the
    least in their other columns. Columns stay as they are.

    Documents are near-duplicates if the exact Jaccard similarity of their shingles is
    ``similarity`` or more (wordless ones are alike); a group is what such links reach. An
    empty table gives no rows. Texts are not shuffled, but for those that share a shingle
    with a like fingerprint.
    """
    scratch = Scratch(docs.sparkSession)
    row = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    sets = scratch.written(shingle_sets(rows, shingle, similarity), "row-sets")
    roots = similar_components(rows, sets, scratch, similarity, shingle, radius, tile)
    classes = sets.select("row", "vertex").distinct().join(roots, "vertex", "left").select("row", F.coalesce("root", "vertex").alias("root"))
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in (id_col, text_col)]
    # of rows equal in id and text one stays, by a hash of the rest: a narrow table decides
    narrow = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.lit(0), *others).alias("rest")).distinct()
    first = narrow.groupBy("row").agg(F.min(F.struct("id", "rest")).alias("f")).select("row", "f.id", "f.rest")
    stays = classes.join(first, "row").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row", "rest")).alias("s")).select("s.row", "s.rest")
    stays = scratch.written(stays, "stays", keep=True)
    scratch.clear()
    keyed = docs.select(F.struct("*").alias("doc"), row.alias("row"), F.xxhash64(F.lit(0), *others).alias("rest"))
    kept = keyed.join(stays, ["row", "rest"], "left_semi")
    # rows equal in all columns are many copies of one; the join has brought them together
    return kept.dropDuplicates(["row", "rest"]).select("doc.*")
