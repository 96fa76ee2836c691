"""Order-sensitive groups: many small ones within seconds, and as a plain loop has them."""

import time

from pyspark.sql import functions as F

PAGES = 6000


def _boxes(spark):
    k = F.col("id")
    return spark.range(PAGES * 3).select(
        F.expr("id div 3").alias("page_id"), (k % 3).cast("int").alias("n"), (k * 37 % 90).cast("double").alias("x"), (k * 53 % 70).cast("double").alias("y"), (k % 11 + 5).cast("double").alias("width"),
        (k % 7 + 4).cast("double").alias("height"),
    )


def _touch(a, b, gap=0):
    return a[0] < b[2] + gap and b[0] - gap < a[2] and a[1] < b[3] + gap and b[1] - gap < a[3]


def _union(a, b):
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _pages(rows, pad=0):
    pages = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.n)):
        pages.setdefault(r.page_id, []).append((r.x - pad, r.y - pad, r.x + r.width + pad, r.y + r.height + pad))
    return pages


def test_crops_of_many_pages(spark):
    from palisade.operators.words import crops

    boxes = _boxes(spark)
    began = time.monotonic()
    got = {(r.page_id, r.crop, r.x, r.y, r.width, r.height) for r in crops(boxes).collect()}
    assert time.monotonic() - began < 30
    want = set()
    for page, now in _pages(boxes.collect(), 8.0).items():
        for _ in range(2):
            out = []
            for a in now:
                for k, b in enumerate(out):
                    if _touch(a, b):
                        out[k] = _union(a, b)
                        break
                else:
                    out.append(a)
            now = out
        want |= {(page, k, x, y, u - x, v - y) for k, (x, y, u, v) in enumerate(now)}
    assert got == want


def test_merged_regions_of_many_pages(spark):
    from palisade.operators.redact import merged

    boxes = _boxes(spark).select("page_id", "n", F.lit("mask").alias("mode"), F.struct("x", "y", "width", "height").alias("r"), F.lit("a").alias("pii_type"))
    began = time.monotonic()
    got = {(r.page, r.x, r.y, r.width, r.height, r.pii_types) for r in merged(boxes, "page_id", "mode", "n").collect()}
    assert time.monotonic() - began < 30
    want = set()
    for page, waiting in _pages(_boxes(spark).collect()).items():
        while waiting:
            own = waiting.pop()
            while near := [b for b in waiting if _touch(own, b, 6)]:
                own = _union(own, near[-1])
                waiting.remove(near[-1])
            want.add((page, own[0], own[1], own[2] - own[0], own[3] - own[1], "a"))
    assert got == want


def test_lines_of_many_pages(spark):
    from palisade.operators.words import lines

    k = F.col("id")
    words = spark.range(PAGES * 4).select(
        F.expr("id div 4").alias("page_id"), F.concat(F.lit("w"), k % 4).alias("text"), (200.0 - k % 4 * 50).alias("x"), (k % 2 * 40.0 + k % 4 / 2).alias("y"), F.lit(30.0).alias("width"), F.lit(12.0).alias("height"),
        F.when(k % 4 != 3, (k % 4 + 1) / 5).alias("confidence"),
    )
    began = time.monotonic()
    got = {tuple(r) for r in lines(words).collect()}
    assert time.monotonic() - began < 30
    first, second = ("w2 w0", "w2w0", 100.0, 0.0, 130.0, 13.0), ("w3 w1", "w3w1", 50.0, 40.5, 130.0, 13.0)
    assert got == {(p, j, 2, *line, sure) for p in range(PAGES) for j, line, sure in ((0, first, (0.6 + 0.2) / 2), (1, second, 0.4))}
