"""Token counts by a two-tier lookup on the map side.

A text falls apart into pre-tokens that no merge of the vocabulary reaches over, so
its count is the sum of theirs. Tier one is a compact hash table of frequent
pre-tokens and their counts, broadcast once; tier two is a bounded cache in each
Python worker, which encodes what tier one lacks. No pre-token is ever shuffled for
the counting itself: a text is read, counted and dropped in one task.

The table only saves work: whichever pre-tokens it holds, the counts are the same.
So it may be filled from a bounded sample of rows (``SAMPLE_ROWS``), and it has a
fixed number of entries (``TABLE_ENTRIES``), which bounds the broadcast.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .worker_cache import WHITE, WorkerCache

#: Rows about which the table of frequent pre-tokens is counted over; its size affects speed alone.
SAMPLE_ROWS = 2000
TABLE_ENTRIES = 32_768
#: A pre-token: spaces and what follows up to the next space.
_SPACED = re.compile(r" *[^ ]+| +")


class LengthTable:
    """Open addressing over arrays: key bytes in one blob, their ends, their counts."""

    def __init__(self, keys: list[str], counts: list[int]):
        data = [k.encode() for k in keys]
        self.blob = b"".join(data)
        self.ends = np.cumsum([0, *map(len, data)]).astype(np.uint32)
        self.counts = np.array(counts, np.uint32)
        self.slots = np.zeros(1 << max(1, (2 * len(keys)).bit_length()), np.uint32)
        mask = len(self.slots) - 1
        for k, key in enumerate(data):
            at = xxhash.xxh64_intdigest(key) & mask
            while self.slots[at]:
                at = (at + 1) & mask
            self.slots[at] = k + 1

    def get(self, key: str) -> int | None:
        data, mask = key.encode(), len(self.slots) - 1
        at = xxhash.xxh64_intdigest(data) & mask
        while k := int(self.slots[at]):
            if self.blob[self.ends[k - 1] : self.ends[k]] == data:
                return int(self.counts[k - 1])
            at = (at + 1) & mask
        return None


_MODELS: dict[str, object] = {}


class _Pieces:
    """Pre-tokens of a sentencepiece BPE model and their counts.

    A pre-token is written as it stands in the text after its newlines were given a
    space before them: with no space it stands for a space and itself, with a first
    newline for itself; what has spaces stands for itself. Texts with runs of spaces
    take the pattern instead.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # the model puts one space before each text: what must not have it is encoded behind a newline
        self.lead = len(self.model.encode("\n"))

    def alone(self, text: str) -> bool:
        """Whether a text must be counted whole: the model's own mark of a space isn't told from spaces."""
        return "\u2581" in text

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        spaced = text.replace("\n", " \n")
        if "  " not in spaced and text[0] not in " \n" and text[-1] != " " and "\0" not in text:
            return spaced.split(" ")
        return ["\0" + p for p in _SPACED.findall(" " + text)]

    def count(self, pieces: list[str]) -> list[int]:
        texts, less = [], []
        for p in pieces:
            if p[0] == "\0" and p.strip("\0 "):  # it begins with a space: the one that the model puts first
                texts.append(p[2:])
                less.append(0)
            elif p[0] == "\0":  # nothing but spaces (and NULs)
                texts.append("\n" + p[1:])
                less.append(self.lead)
            elif p[0] == "\n":
                texts.append("\n" + p)
                less.append(self.lead)
            else:
                texts.append(p)
                less.append(0)
        got: list[int] = []
        for at in range(0, len(texts), 4096):
            got += map(len, self.model.encode(texts[at : at + 4096], num_threads=1))
        return [n - k for n, k in zip(got, less, strict=True)]


class _Library:
    """Pre-tokens of a byte-level model of the tokenizers library: white space and what
    follows it up to the next white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.pattern = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

    def alone(self, text: str) -> bool:
        return False

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, pieces: list[str]) -> list[int]:
        got: list[int] = []
        for at in range(0, len(pieces), 4096):
            got += [len(e.ids) for e in self.model.encode_batch(pieces[at : at + 4096], add_special_tokens=False)]
        return got


def _model(path: str):
    if path not in _MODELS:
        own = _Pieces(path) if path.endswith(".model") else _Library(path)
        _MODELS[path] = own, WorkerCache(own.count)
    return _MODELS[path]


def frequent_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text", rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> LengthTable:
    """The table of tier one: the most frequent pre-tokens of about ``rows`` sampled
    texts. Each task sends its own most frequent ones; their sums are cut to
    ``entries`` before the driver gets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(tokenizer)
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if not model.alone(t or ""):
                    seen.update(p for p in model.split(t or "") if len(p) <= 64)
            if len(seen) > 8 * entries:
                seen = Counter(dict(seen.most_common(4 * entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_pydict({"p": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    n = docs.count()
    if not n:
        return LengthTable([], [])
    some = docs.select(text_col).where(F.rand(7) < min(1.0, rows / n))
    top = map_batches(some, run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").limit(entries)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _model(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.count(b.column(0).to_pylist()), pa.int64())], names=["p", "k"])

    found = top.mapInArrow(lengths, "p string, k long").collect()
    return LengthTable([r["p"] for r in found], [r["k"] for r in found])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit), as the library of ``tokenizer`` counts (sentencepiece for a
    .model, tokenizers for a byte-level .json), without begin, end or added tokens.

    Null texts are empty and have 0 tokens. Repeated rows, null ids and other columns
    do not matter; an empty table gives no rows.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _model(tokenizer)
        first = table.value

        seen: dict[str, int] = {}  # what this task has looked up in either tier
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            whole = {k: model.whole(t) for k, t in enumerate(texts) if model.alone(t)}
            split = [[] if k in whole else model.split(t) for k, t in enumerate(texts)]
            if len(seen) > cache.limit:
                seen.clear()
            wanted = set().union(*split).difference(seen)
            for p in wanted:
                if (n := first.get(p)) is not None:
                    seen[p] = n
            missed = wanted.difference(seen)
            cache.ready([missed])
            seen.update((p, cache[p]) for p in missed)
            counts = [whole.get(k, 0) + sum(map(seen.__getitem__, s)) for k, s in enumerate(split)]
            for p in cache.done():
                seen.pop(p, None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
