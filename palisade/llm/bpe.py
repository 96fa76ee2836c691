"""Byte-level BPE encoding and decoding by batched merge rounds in numpy.

A text is cut at white space into chunks (white space and what follows it), which no
pre-token reaches over; a bounded worker cache holds the ids of chunks. The chunks
that it lacks are cut into pre-tokens, and all new pre-tokens of a batch are merged
together: their symbols stand in one flat array, and in each round every word's
lowest-ranked pair, found by binary search over the sorted pair keys, is merged
wherever the word has it. Words without a pair that merges leave the round.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .worker_cache import WHITE, WorkerCache

#: The public split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1) << 40  # rank of a pair that doesn't merge


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class MergeTable:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        to_byte = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in piece)
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.split = regex.compile(SPLIT)
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.specials = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (its bytes), all merged round by round together."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], _NONE)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            least = np.minimum.reduceat(np.concatenate([rank, [_NONE]]), starts)
            lengths = np.diff(np.concatenate([starts, [len(symbols)]]))
            best = np.repeat(least, lengths)
            live = best < _NONE
            hit = np.concatenate([rank == best[:-1], [False]]) & live
            if not hit.any():
                break
            if not live.all():  # finished words leave
                done.append((owner[~live], symbols[~live]))
                at = np.concatenate([at, [0]])[live]
                symbols, owner, hit = symbols[live], owner[live], hit[live]
            # a run of overlapping hits (equal symbols): every other one, from its start
            where = np.flatnonzero(hit)
            run = np.concatenate([[True], np.diff(where) != 1])
            begin = where[run][np.cumsum(run) - 1]
            where = where[(where - begin) % 2 == 0]
            symbols[where] = self.merged[at[where]]
            stay = np.ones(len(symbols), bool)
            stay[where + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        done.append((owner, symbols))
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        ids, ends = np.concatenate([s for _, s in done])[order], np.cumsum(np.bincount(owners, minlength=len(words)))
        return np.split(ids, ends[:-1])

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks as little-endian int32."""
        cut = [self.split.findall(c) for c in chunks]
        words = list(set().union(*cut))
        got: dict[str, bytes] = {}
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for w, ids in zip(part, self.merge_words([w.encode() for w in part]), strict=True):
                got[w] = ids.astype("<i4").tobytes()
        return [b"".join(map(got.__getitem__, c)) for c in cut]

    def pieces(self, text: str) -> list[str]:
        """Chunks of a text, and its special strings as chunks of their own."""
        if self.specials is None or not any(s in text for s in self.added):
            return self.chunks.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.specials.split(text)):
            out += [part] if k % 2 else self.chunks.findall(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Bytes of all ids joined; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_TABLES: dict[str, tuple[MergeTable, WorkerCache]] = {}


def _loaded(path: str) -> tuple[MergeTable, WorkerCache]:
    if path not in _TABLES:
        table = MergeTable(path)

        def many(chunks: list[str]) -> Iterator[bytes]:
            plain = [c for c in chunks if c not in table.added]
            got = dict(zip(plain, table.encode_chunks(plain), strict=True)) if plain else {}
            return (np.array([table.added[c]], "<i4").tobytes() if c in table.added else got[c] for c in chunks)

        _TABLES[path] = table, WorkerCache(many)
    return _TABLES[path]


#: Ids that one output batch holds, but for a longer single text.
_OUT_IDS = 1 << 20


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, ids array<int>, the ids of the whole text as
    the tokenizers library gives them (special strings inside a text are special
    tokens; nothing is added, cut or padded), and with ``decoded`` a column decoded,
    what the ids decode to.

    Null texts are empty and have no ids. Repeated rows, null ids, other columns do
    not matter; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = _loaded(tokenizer)
        for b in batches:
            cut = [table.pieces(t or "") for t in b.column(1).to_pylist()]
            cache.ready(cut)
            own = [np.frombuffer(b"".join(map(cache.__getitem__, c)), "<i4") for c in cut]
            cache.done()
            first = 0
            while first < len(own):
                last, n = first + 1, len(own[first])
                while last < len(own) and n + len(own[last]) <= _OUT_IDS:
                    n += len(own[last])
                    last += 1
                part = own[first:last]
                ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
                cols = [b.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part).astype(np.int32)))]
                if decoded:
                    cols.append(pa.array([table.decode(x.tolist()) for x in part], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "ids", "decoded"][: len(cols)])
                first = last

    kind = dict(docs.dtypes)[id_col]
    out = map_batches(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
        f"id {kind}, ids array<int>" + ", decoded string" * decoded,
    )
    return out.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """id_col and text: what the ids of each row decode to. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _loaded(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([table.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    kind = dict(rows.dtypes)[id_col]
    out = map_batches(rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
