"""The corpus operators against brute force on small tables with nulls, ties and odd texts."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

T = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target double, root long"


def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [prose(rnd.randrange(60, 200)) for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    lines = ["\n".join([prose(12), base[9][:60], prose(8), "short one"]) for _ in range(6)]
    odd = [None, "", " ", "\n\n", "one", "two words", "three of them", "É é x  y\t\x0b z", "<|endoftext|> a <|endoftext|>", "日本語 テキスト 😀", "a" * 5000, "x y " * 3000]
    return base + near + lines + base[:5] + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", ["a", "b", None, "c"][k % 4], 0, 1.0, 7) for k, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "no id at all", "en", "a", 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1: SimHash --------------------------------------------------------------------------------
def _fp(text, shingle):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(docs):
    from palisade.llm import simhash

    got = [(r.doc_id, r.f0 & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, radius=2, shingle=3).collect()]
    rows = [(r.doc_id, _fp(r.text, 3)) for r in docs.collect()]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    assert Counter(got) == Counter((d, f, least.get(find(f))) for d, f in rows)


def test_simhash_tiles_lose_no_link(spark):
    from palisade.llm import simhash
    from palisade.llm.components import components

    rnd = random.Random(1)
    fps = {0}
    while len(fps) < 400:
        fps.add(rnd.choice(sorted(fps)) ^ 1 << rnd.randrange(63))
    table = spark.createDataFrame([(f, f) for f in fps], "vertex long, f0 long")
    for tile in (16, 4096):
        roots = components(simhash.links(table, 1, 2, simhash.block_masks(2), tile))
        assert roots.count() == 399 and roots.select("root").distinct().count() == 1


def test_near_copies_leave_one(spark, docs, nothing):
    from palisade.llm import simhash

    rnd = random.Random(2)
    words = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    copies = []
    for k in range(6):
        w = list(words)
        for _ in range(4):
            w[rnd.randrange(400)] = f"n{rnd.randrange(10**6)}"
        copies.append((k, " ".join(w)))
    clean = [(100 + k, " ".join(f"w{rnd.randrange(5000)}" for _ in range(400))) for k in range(20)]
    left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(copies + clean, "doc_id long, text string")).collect()}
    assert left == {0} | set(range(100, 120))
    assert simhash.keep_one(nothing).columns == nothing.columns and simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(docs).where("doc_id is null").count() == 1


def _edited_pairs(rnd, pairs, n, changes):
    """Texts (2k, t), (2k + 1, t with so many words changed), and each pair's exact Jaccard."""
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(n - 4)}
    rows, found = [], []
    for k in range(pairs):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        t = list(w)
        for c in range(changes):
            t[c * n // changes + 6 + rnd.randrange(n // changes - 12)] = f"n{rnd.randrange(10**6)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(t))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        found.append(len(a & b) / len(a | b))
    return rows, found


def test_all_pairs_at_the_similarity_are_found(spark):
    from palisade.llm import simhash

    rows, found = _edited_pairs(random.Random(12), 60, 200, 4)
    assert all(0.8 <= x <= 0.85 for x in found)
    left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == set(range(0, 120, 2))


def test_pairs_below_the_similarity_stay(spark):
    from palisade.llm import simhash

    rows, found = _edited_pairs(random.Random(13), 60, 200, 5)
    assert all(0.75 <= x < 0.8 for x in found)
    assert simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 120


def test_unlike_texts_that_share_an_id_stay(spark):
    from palisade.llm import simhash

    rnd = random.Random(14)
    prose = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    rows = [(1, prose()), (1, prose()), (None, prose()), (None, prose())]
    more = [(2, rows[0][1]), rows[1], (None, rows[2][1])]
    left = simhash.keep_one(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()
    assert sorted(map(str, left)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in rows)


def test_components(spark):
    from palisade.llm.components import components

    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (None, 4)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 9: 7} | {k: 100 for k in range(101, 161)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 2: quality rules ----------------------------------------------------------------------------
def _measures(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_verdicts(docs, nothing):
    from palisade.llm import quality

    got = quality.judged(docs)
    for r in got.collect():
        n, chars, symbols, dup, repeat = _measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r.text
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count() > 10
    assert quality.accepted(nothing).count() == 0


# ---- 3: records -------------------------------------------------------------------------------------
def test_records_round_trip(spark, docs, nothing):
    from tokenizers import Tokenizer

    from palisade.llm import records

    path = T.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    start, want = 0, []
    for there, d, _, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.append((d if there else None, start, len(ids), ids))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids) for r in records.token_records(docs, path, 1, ids=True).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert records.token_records(nothing, path, 1).count() == 0


def test_records_find_damage(tmp_path):
    import numpy as np

    from palisade.llm import records

    data = records.frame(records.payload(5, np.array([1, 2, 3], "<u4"), 2))
    assert records.parse(records.unframe(memoryview(data)))[0] == 5
    for k in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(memoryview(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]))


def test_records_shuffled_reads(spark, docs):
    from palisade.llm import records
    from palisade.llm.common import fresh_path

    folder = fresh_path(spark, "records")
    manifest = records.write_records(docs, folder, T.path("word_bpe_49k.json"), 1).collect()
    store, _ = records._store(folder)
    m = max(manifest, key=lambda m: m["docs"])
    index = records.read_index(store, m["file"], 0, m["docs"])
    whole = [(d, x.tolist()) for d, x in records.read_at(store, m["file"], index)]
    order = list(range(m["docs"]))
    random.Random(3).shuffle(order)
    assert [(d, x.tolist()) for d, x in records.read_at(store, m["file"], index[order])] == [whole[k] for k in order]


# ---- 5: mixing ----------------------------------------------------------------------------------------------
def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left, weight = total - sum(out.values()), sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / weight > 3 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / weight for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)


def test_mixing_meets_targets(spark, nothing):
    from pyspark.sql import functions as F

    from palisade.llm import mixing

    rnd = random.Random(6)
    rows = [(k, "t", rnd.choice(["a"] * 30 + ["b", "c", None, "d"]), rnd.randrange(0, 400)) for k in range(3000)] + [(9000, None, "z", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    found = mixing.mixed(table, F.col("size"))
    got = found.collect()
    sizes = Counter()
    for _, _, s, n in rows:
        sizes[s] += n
    want, taken = _targets(sizes), Counter()
    for r in got:
        assert r["__copies"] <= 3 and abs(r["__target"] - want[r.source]) < 1e-6 and r["__source_size"] == sizes[r.source]
        taken[r.source] += r["__copies"] * r.size
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 30, (s, taken[s], goal)
    again = {r.doc_id: r["__copies"] for r in mixing.mixed(table.repartition(7), F.col("size")).collect()}
    assert again == {r.doc_id: r["__copies"] for r in got}
    assert mixing.repeated(table, F.col("size")).count() == sum(r["__copies"] for r in got)
    assert mixing.repeated(nothing, F.lit(1)).count() == 0


# ---- 6: BPE ---------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(docs, nothing):
    from tokenizers import Tokenizer

    from palisade.llm import bpe

    path = T.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = bpe.encode(docs, path, decoded=True).collect()
    want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert Counter((r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs, path), path).collect()) == Counter((d, t) for d, _, t in want.elements())
    assert bpe.encode(nothing, path).count() == 0


# ---- 7: sharding ------------------------------------------------------------------------------------------------
def test_shards_are_even_and_keep_groups(spark, docs, nothing):
    from palisade.llm import sharding

    rows = [(k, f"text {k}") for k in range(600)] + [(1000 + k, f"group {k // 6}") for k in range(240)] + [(3000 + k, "the hot one") for k in range(400)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    by = Counter(r.shard for r in got)
    assert max(by.values()) - min(by.values()) <= 1 and len(by) == 8
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    own = dict(rows)
    assert all(r.size == len(own[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(own[r.doc_id].encode()) for r in got)
    parted = sum(len({r.shard for r in got if 1000 + 6 * k <= r.doc_id < 1006 + 6 * k}) > 1 for k in range(40))
    assert parted <= 8  # one a boundary at most, not by chance in nearly every group
    assert sharding.sharded(docs).count() == docs.count() and sharding.sharded(nothing).count() == 0


# ---- 8: pages ----------------------------------------------------------------------------------------------------
def test_pages(spark):
    from palisade.llm import html_extract

    page = lambda menu, body: f"<html><head><title>x</title><script>'</p>'</script></head><body><div>{menu}</div><div>{body}</div></body></html>"
    art = "<body><nav>menu</nav><header><h1>Site</h1></header><article><h1>T &amp; t</h1><p>one<br>two &nbsp; <b>x</b><p>three</article><footer>f</footer>"
    rows = [
        (1, "http://h.example/a/1", page("Home of things", "first story")), (2, "http://h.example/a/2", page("Home of things", "second story")),
        (3, "http://h.example/b", art), (4, "http://h.example/c", art), (5, "http://alone.example/", page("Only", "here")), (6, None, None), (7, "nonsense", ""),
        (8, "http://x.example/", "<p>a<p>b <!-- c --> <form>no</form><div class='cookie-notice'>no</div><aside>no</aside> tail"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extracted(table).collect()}
    assert got[1] == "first story" and got[2] == "second story"
    assert got[3] == got[4] == "T & t\n\none two x\n\nthree"
    assert got[5] == "Only\n\nhere" and got[6] == "" and got[7] == "" and got[8] == "a\n\nb\n\ntail"
    assert html_extract.extracted(table.where("page_id < 0")).count() == 0


def test_differencing_decides(spark):
    """Chrome of plain blocks goes by alignment alone; copies and unlucky names lose nothing."""
    from palisade.llm import html_extract as H

    chrome = lambda k, body: f"<body><div>The Daily Page</div><div>World</div><div>Visits so far: {k}</div>{body}<div>Written by the staff</div></body>"
    rows = [(k, f"http://h.example/news/{k}", chrome(k, f"<div>story {k} is told here</div><div>and ends so, {k}</div>")) for k in range(10, 20)]
    rows += [(k, f"http://copies.example/a?x={k}", "<div>the very same page</div><div>twice</div>") for k in (30, 31)]
    rows += [(40, "http://names.example/a", "<article class='comment'><h1>Views</h1><p id='related-work'>related work</p><p class='share'>a share of it</p></article><article class='comment'>me too!</article>")]
    quote = "<p>a passage that two articles quote</p>"
    rows += [(50 + k, f"http://quotes.example/{k}", f"<article><h1>Same title</h1><p>Sign up today</p><p>own {k}</p>{quote}<p>end {k}</p><p>Read on</p></article>") for k in range(2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extracted(table).collect()}
    for k in range(10, 20):
        assert got[k] == f"Visits so far: {k}\n\nstory {k} is told here\n\nand ends so, {k}"
    assert got[30] == got[31] == "the very same page\n\ntwice" and got[40] == "Views\n\nrelated work\n\na share of it"
    assert got[50] == "Same title\n\nSign up today\n\nown 0\n\na passage that two articles quote\n\nend 0\n\nRead on"
    gone = H.deletions(table, "page_id", "url", "html").collect()
    assert len(gone) == 10 and all(len(r.gone) == 3 for r in gone)


def test_odd_pages(spark):
    from palisade.llm import html_extract as H

    long = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(30_000)) + "</article>"
    rows = [(None, None, None, 1), (1, "http://x.example/1", None, 1), (2, None, "<p>a", 1), (3, "http://x.example/2", long, 1), (3, "http://x.example/2", long, 1), (4, "http://[bad", "<p>b", 2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, key long")
    got = sorted((r.page_id or 0, r.url or "", r.n_chars, len(r.text)) for r in H.extracted(table).collect())
    n = len("\n\n".join(f"paragraph {k}" for k in range(30_000)))
    assert got == [(0, "", 0, 0), (1, "http://x.example/1", 0, 0), (2, "", 1, 1), (3, "http://x.example/2", n, n), (3, "http://x.example/2", n, n), (4, "http://[bad", 1, 1)]


# ---- 9: fingerprints ------------------------------------------------------------------------------------------------
def test_fingerprints(spark, docs, nothing):
    from palisade.llm import fingerprints as fp

    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    want = Counter()
    for k, (there, d, _, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][3]
        half = len(t) // 2
        want[(d if there else None, len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest())] += 1
    got = fp.compared_with_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in got) == want
    own = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        assert r.fingerprint == fp.text_of(fp.chunks(own[r.doc_id].encode())) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert Counter((r.doc_id, r.fingerprint) for r in fp.fingerprints(docs).collect()) == Counter((r.doc_id, r.fingerprint) for r in got)
    assert fp.compared_with_edits(nothing).count() == 0


def test_chunks_shift_with_the_text():
    from palisade.llm import fingerprints as fp

    data = random.Random(7).randbytes(20_000)
    assert b"".join(data[a:b] for a, b in zip([0, *fp.boundaries(data)], fp.boundaries(data), strict=False)) == data
    a, b = fp.chunks(data), fp.chunks(b"inserted" + data)
    assert fp.containment(a, b) > 0.95 and fp.parse(fp.text_of(a)) == a


# ---- 10: token counts -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(docs, nothing, name):
    from palisade.llm import token_counts

    path = T.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path, 2000).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 2000) for r in docs.collect())
    assert token_counts.token_counts(nothing, path).count() == 0


# ---- letters that the libraries treat in their own way ------------------------------------------------------------------
def _random_texts(alphabet, n=3000):
    rnd = random.Random(31)
    return [(k, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 14)))) for k in range(n)]


def test_records_equal_the_library_on_odd_letters(spark):
    from tokenizers import Tokenizer

    from palisade.llm import records

    path = T.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = _random_texts([*"İΣσςiIlL'’, .1aé", "'LL", "e\u0301", " "])
    got = {r.doc_id: r.ids for r in records.token_records(spark.createDataFrame(rows, "doc_id long, text string"), path, 1, ids=True).collect()}
    assert [d for d, t in rows if got[d] != [*tok.encode(t, add_special_tokens=False).ids, 1]] == []


def test_counts_equal_the_library_on_odd_letters(spark):
    import sentencepiece

    from palisade.llm import token_counts

    path = T.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = _random_texts([*"\u2581\n\t ab.Ａ①\u3000\u00a0", "  ", "<s>"])
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert [d for d, t in rows if got[d] != len(model.encode(t))] == []


# ---- all registered queries ---------------------------------------------------------------------------------------------
def test_registered_queries_have_their_columns(spark, docs, tmp_path):
    from palisade.llm.queries import QUERIES

    docs.drop("target", "root").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "http://a.example/1", "<article>x</article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    n = docs.count()
    want = {
        "op1": "doc_id bigint, fingerprint string, component_id bigint",
        "op2": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op3": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op4": "doc_id bigint, text string, n_chars bigint, n_lines bigint, n_dropped bigint",
        "op5": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op6": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op7": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op8": "page_id bigint, url string, text string, n_chars bigint",
        "op9": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op10": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op11": "lang string, source string, part string, item string, value bigint, rank int",
        "op12": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op13": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    }
    talks = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (None, None, None, None)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sources = docs.select("lang", "source").distinct().count()
    for name, query in QUERIES.items():
        found = query(spark, str(tmp_path))
        op = name.split("_")[0]
        assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == want[op], name
        rows = found.collect()
        if op == "op12":
            assert sum(r.piece == 0 for r in rows) == n
        else:
            # of op11 each source's pairs with the others of the only language, and terms
            least = {"op8": 2, "op13": 2, "op11": sources * (sources - 1)}.get(op, n)
            assert len([r for r in rows if op != "op11" or r.part == "pair"]) == least, name
        if op == "op1":
            assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
        if op == "op7":
            assert all(r.law == "rows" and r.grown_shard is None and 0 <= r["shard"] < 40 for r in rows)


def test_mixing_includes_by_size(spark):
    """The sampled copy takes documents at a rate in proportion to their size; the largest for certain."""
    from pyspark.sql import functions as F

    from palisade.llm import mixing

    sizes = [10, 20, 40, 80, 2000]
    rows = [(k, "a", sizes[k % 4] if k % 500 else 2000) for k in range(20_000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mixed(table, F.col("size"), share=0.3, max_copies=1, key=F.col("doc_id")).groupBy("size").agg(F.avg("__copies").alias("p")).collect()
    p = {r["size"]: r.p for r in got}
    assert p[2000] == 1.0 and all(abs(p[b] / p[a] - 2) < 0.25 for a, b in ((10, 20), (20, 40), (40, 80)) if p[b] < 0.9)


# ---- the pipeline ---------------------------------------------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(8)
    prose = lambda: "\n".join(" ".join(f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}" for _ in range(40)) for _ in range(3))
    rows = [(k, prose(), "en", f"s{k % 3}", 0) for k in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "too short", "en", "s1", 0), (102, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        if k < 3:
            assert {r.doc_id for r in docs.collect()} >= set(range(40))
    assert not {r.doc_id for r in docs.collect()} & {100, 101, 102}
    assert P.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids"]
