"""Packing into sequences: whole documents, exact ids, gapless places, few sequences."""

import random
import zlib

import numpy as np
import pytest
from test_operators import texts

SCHEMA = "doc_id long, text string, piece string, bin long, key int, ids int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1, 2, 3) for k, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "no id", "x", 1, 2, 3), (900, "b " * 4095, "x", 1, 2, 3), (901, " " * 70_000 + "x", "x", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(7).cache()


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return P.path("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_pieces_and_sequences(docs):
    from palisade.llm import packing

    path, tok = tokenizer()
    size = 128
    out = packing.packed(docs, path, end_id=2, size=size, ids=True).cache()
    got = {}
    for r in out.collect():
        assert r.length == len(r.ids) <= size
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    expected = {}
    for r in docs.collect():
        expected.setdefault(r.doc_id, []).append(tok.encode(r.text or "", add_special_tokens=False).ids + [2])
    assert got.keys() == expected.keys()
    for doc, pieces in got.items():
        copies = len(expected[doc])
        pieces.sort(key=lambda p: p[:2])
        ids = [i for p in pieces[::copies] for i in p[2]]
        assert ids == expected[doc][0]
        for p, group in enumerate(pieces[::copies]):
            assert group[0] == p and group[1] == sum(len(x[2]) for x in pieces[::copies][:p])
            assert p == 0 or len(group[2]) == size  # the first alone may be shorter
    places = {}
    for r in out.collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    whole = packing.sequences(out).collect()
    assert {r.sequence_id for r in whole} == set(places) and sum(len(r.ids) for r in whole) == sum(n for held in places.values() for _, n in held)


def test_bins_against_brute_force():
    from palisade.llm.packing import OpenBins

    rnd = random.Random(3)
    for most in (1, 2, 5, 40):
        bins, free, closed = OpenBins(50, most), {}, set()
        for _ in range(800):
            n = rnd.randrange(1, 50)
            found, at = bins.put(n)
            fits = sorted((f, b) for b, f in free.items() if f >= n)
            if fits:
                assert free[found] == fits[0][0] and at == 50 - free[found]
            else:
                assert found not in free and found not in closed and at == 0
                if len(free) == most:
                    least = min(free.values())
                    gone = [b for b, f in free.items() if f == least and b not in dict(bins.still_open())]
                    assert len(gone) == 1
                    closed.add(gone[0])
                    del free[gone[0]]
                free[found] = 50
            free[found] -= n
            if not free[found]:
                closed.add(found)
                del free[found]
            assert {b: 50 - t for b, t in bins.still_open()} == free


def test_groups_hand_on_what_is_open(spark, docs, monkeypatch):
    """With groups of two and tasks of eight pieces the places stay gapless, the sequences few."""
    from palisade.llm import packing

    path, _ = tokenizer()
    monkeypatch.setattr(packing, "PER_TASK", 8)
    rows = packing.packed(docs, path, end_id=2, size=700, fan=2).collect()
    places, total = {}, 0
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 700
    assert len(places) <= 1.15 * -(-total // 700) + 1


def test_empty_table(spark):
    from palisade.llm import packing

    path, _ = tokenizer()
    assert packing.packed(spark.createDataFrame([], SCHEMA), path, end_id=2).collect() == []
