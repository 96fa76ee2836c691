"""Near-duplicates under keys that far more texts share than one task compares."""

import random


def test_shared_shingle_of_thousands(spark):
    """All texts share a shingle; every truncated copy (similarity 0.8) goes, nothing else."""
    from palisade.llm import simhash

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    for n, tile in ((20_000, simhash.TILE), (40_000, simhash.TILE), (2_000, 50)):
        texts = [" ".join([word(), word(), "the line that all share", word(), word()]) for _ in range(n)]
        copies = [t.rsplit(" ", 1)[0] for t in texts[:200]]
        rows = list(enumerate(texts + copies))
        left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).select("doc_id").collect()}
        assert left == set(range(n))


def test_crowds_under_one_shingle(spark):
    """Groups of hundreds of near copies beside each other under one shingle: one text of each stays, as brute force says."""
    from palisade.llm import simhash

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    rows, shared = [], "one line stands in every single text"
    for _ in range(4):
        base = [word() for _ in range(40)]
        for _ in range(150):
            own = list(base)
            own[rnd.randrange(len(own))] = word()
            rows.append((len(rows), " ".join([shared, *own])))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    expected = {k for k in range(len(rows)) if find(k) == k}
    for tile in (simhash.TILE, 40):
        left = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).select("doc_id").collect()}
        assert left == expected
