"""Token ids in length-delimited binary record files with an offset index.

A data file is a run of frames:

    length    uint64, little-endian: bytes of the payload
    check     uint32: masked CRC-32 of the length's eight bytes
    payload
    check     uint32: masked CRC-32 of the payload

A payload is one document: width of an id (uint8: 2 or 4), whether doc_id is there
(uint8), doc_id (int64), then its ids. Masked: the CRC turned right by 15 bits plus
0xA282EAD8, so that a checksum of data that holds checksums stays sound.

The index beside it (``.idx``) is the magic, a count, and for each frame its offset
(uint64), payload bytes (uint64), ids (uint64) and the ids before it (uint64), so that frames can be read in any
order without a scan of the data file.

Writing: documents are dealt out by range of doc_id, each task streams one data file
and its index under a name of its own, and its row in the manifest (a Parquet table)
names them. Only files named in the manifest count, so a task that ran twice or was
lost leaves nothing that is read. Paths go through pyarrow's file systems, so that a
shared store serves as well as a shared folder.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_batches, written
from .worker_cache import WorkerCache

MAGIC = b"PLSIDX02"
INDEX = np.dtype([("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8"), ("before", "<u8")])
#: Bytes of data that a reader holds at once, but for a larger single frame.
READ_BYTES = 8 << 20
#: Frames that one reading task takes from the index at once.
SLICE = 20_000
_HEAD = struct.Struct("<BBq")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview) -> memoryview:
    """The payload of a frame; ValueError if a checksum or length is wrong."""
    if len(data) < 16 or masked(bytes(data[:8])) != struct.unpack_from("<I", data, 8)[0]:
        raise ValueError("record length is damaged")
    (n,) = struct.unpack_from("<Q", data, 0)
    if len(data) != n + 16 or masked(bytes(data[12 : 12 + n])) != struct.unpack_from("<I", data, 12 + n)[0]:
        raise ValueError("record is damaged")
    return data[12 : 12 + n]


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def parse(data: memoryview) -> tuple[int | None, np.ndarray]:
    width, there, doc_id = _HEAD.unpack_from(data, 0)
    return doc_id if there else None, np.frombuffer(data, f"<u{width}", offset=_HEAD.size)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class TextEncoder:
    """Ids of whole texts as little-endian uint32, as the tokenizers library gives them.

    A vocabulary whose words end in a suffix tells by its ids where a word ends. So a
    text is cut into pre-tokens, a bounded cache holds the pre-tokens' ids, and those
    that it lacks are encoded many to a text and told apart by their last ids. Texts with
    a special string, and all texts of any other vocabulary, are encoded whole.
    """

    JOINED = 256

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        pattern = steps[0]["pattern"]["Regex"] if suffix and steps and steps[0]["type"] == "Split" else None
        self.split = regex.compile(pattern) if pattern else None
        # the same pattern over lower-case ASCII
        ascii_classes = {r"[\p{L}]+": "[a-z]+", r"[\p{N}]": "[0-9]", r"[^\s\p{L}\p{N}]+": r"[^\t-\r a-z0-9]+"}
        parts = pattern.split("|") if pattern else []
        self.split_ascii = re.compile("|".join(ascii_classes.get(p, p) for p in parts)) if parts else None
        self.last = np.zeros(self.size, bool)
        if suffix:
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            self.last[[vocab[t] for t in self.added]] = False
        self.words = WorkerCache(self._words, limit=400_000)

    def _alone(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 2048):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts[at : at + 2048], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 64 * self.JOINED):
            parts = [words[k : k + self.JOINED] for k in range(at, min(at + 64 * self.JOINED, len(words)), self.JOINED)]
            for part, e in zip(parts, self.tok.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):
                    data, ends = ids.tobytes(), (4 * ends).tolist()
                    out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                else:
                    out += self._alone(part)
        return out

    def _cut(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None if it must be encoded whole."""
        # these two letters' lower case depends on who makes it and on what stands around them
        if self.split is None or "\u0130" in text or "\u03a3" in text or any(a in text for a in self.added):
            return None
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.split.findall(text.lower()) if "\u0130" not in text and "\u03a3" not in text else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        self.words.ready(c for c in cut if c)
        get = self.words.__getitem__
        out = [b"".join(map(get, c)) if c is not None else self._alone([t])[0] for t, c in zip(texts, cut, strict=True)]
        self.words.done()
        return out


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _write(tokenizer: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        width = 2 if max(encode.size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        store, root = _store(folder)
        name = f"{root}/shard-{part:06d}-{uuid.uuid4().hex}"
        out, index, at, tokens = None, [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(name + ".rec")
            for doc_id, own in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids = np.frombuffer(own + end, "<u4")
                data = frame(payload(doc_id, ids, width))
                out.write(data)
                index.append((at, len(data) - 16, len(ids), tokens))
                at, tokens = at + len(data), tokens + len(ids)
        if out is not None:
            out.close()
            with store.open_output_stream(name + ".idx") as f:
                f.write(MAGIC + struct.pack("<Q", len(index)) + np.array(index, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "docs": [len(index)], "tokens": [tokens]})

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes record files to
    ``folder`` in ascending id order (null ids first; equal ids in order of text).

    Null texts are empty: they hold the end id alone. Repeated rows are written as
    often as they are there; an empty table writes no file. Other columns are not
    read. Returns the manifest: part, file (without suffix), docs, tokens.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    )
    return written(map_batches(dealt, _write(tokenizer, end_id, folder), "part int, file string, docs long, tokens long"), "manifest")


def read_index(store: pafs.FileSystem, name: str, first: int, n: int) -> np.ndarray:
    with store.open_input_file(name + ".idx") as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{name}.idx is no index")
        f.seek(16 + first * INDEX.itemsize)
        return np.frombuffer(f.read(n * INDEX.itemsize), INDEX)


def read_at(store: pafs.FileSystem, name: str, entries: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents at these index entries, in their order. Entries that follow one
    another in the file are read together."""
    with store.open_input_file(name + ".rec") as f:
        k = 0
        while k < len(entries):
            end, size = k + 1, int(entries[k]["bytes"]) + 16
            while end < len(entries) and entries[end]["offset"] == entries[k]["offset"] + size and size < READ_BYTES:
                size += int(entries[end]["bytes"]) + 16
                end += 1
            f.seek(int(entries[k]["offset"]))
            data, at = memoryview(f.read(size)), 0
            for e in entries[k:end]:
                step = int(e["bytes"]) + 16
                yield parse(unframe(data[at : at + step]))
                at += step
            k = end


def slices(manifest: DataFrame) -> DataFrame:
    """Rows (file, first, n, start): parts of the index to read, and the ids before
    each file. The driver holds one row for each file, of which there is one a task."""
    spark, rows, before = manifest.sparkSession, [], 0
    for m in sorted(manifest.collect(), key=lambda m: m["part"]):
        rows.append((m["file"], m["docs"], before))
        before += m["tokens"]
    files = spark.createDataFrame(rows, "file string, docs long, start long").repartition(max(1, min(len(rows), 4096)))
    return files.select(
        "file", "start", F.explode(F.expr(f"sequence(0L, docs - 1, {SLICE}L)")).alias("first"), F.lit(SLICE).alias("n")
    )


def read_records(spark: SparkSession, manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """Reads record files back and checks every checksum: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of the ids as little-endian uint32)
    and, if asked, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for b in batches:
            for r in b.to_pylist():
                entries = read_index(store, r["file"], r["first"], r["n"])
                start = r["start"] + int(entries["before"][0])
                for at in range(0, len(entries), 512):
                    got = list(read_at(store, r["file"], entries[at : at + 512]))
                    counts = np.array([len(x) for _, x in got], np.int64)
                    cols = {
                        "doc_id": pa.array([d for d, _ in got], pa.int64()),
                        "start": pa.array(start + np.cumsum(counts) - counts),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in got], pa.int64()),
                    }
                    if ids:
                        cols["ids"] = pa.array([x.astype(np.int64) for _, x in got], pa.list_(pa.int64()))
                    start += int(counts.sum())
                    yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return slices(manifest).mapInArrow(run, schema)


def token_records(docs: DataFrame, tokenizer: str, end_id: int, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the records of ``docs`` to the shared folder and reads them back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "records")
    return read_records(spark, write_records(docs, folder, tokenizer, end_id, id_col, text_col), folder, ids)
