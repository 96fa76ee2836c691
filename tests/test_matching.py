"""Matches of all rules found in batches of texts."""

from pyspark.sql import functions as F


def test_rules_go_through_texts_in_batches(spark):
    from palisade.operators import detect_text

    plan = spark.range(1).select(detect_text.find_patterns(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_odd_texts_and_edges_of_the_context(spark):
    from palisade.operators.detect_text import find_patterns

    cases = [
        (None, None, None), ("", None, []), ("nothing", "otp", []),
        ("é😀 A1234567.", None, [(3, 11, "passport")]), ("éA1234567", None, [(1, 9, "passport")]), ("_A1234567", None, []),
        ("x 2345 6789 0124", None, [(2, 16, "aadhaar")]), ("x 2345​6789​0124", None, []),
        # case of ASCII letters alone is ignored: no Kelvin sign, no long s
        ("1 HDKC0001234 hdfc0001234", None, [(14, 25, "ifsc")]), ("paſscode 4711 passcode", None, [(9, 13, "otp")]), ("paſscode 4711", None, []),
        ("otp " + "." * 44 + "4711", None, [(48, 52, "otp")]), ("otp " + "." * 45 + "4711", None, []), ("4711", "your otp", [(0, 4, "otp")]),
        # a match that fails its check is used up, one that overlaps an earlier rule's is dropped
        ("card 4111 1111 1111 1112", None, []), ("bank 4111111111111111", None, [(5, 21, "credit_card")]),
    ]
    rows = spark.createDataFrame([(k, t, c) for k, (t, c, _) in enumerate(cases)], "k int, t string, c string").coalesce(1)
    for r in rows.select("k", find_patterns(F.col("t"), F.col("c")).alias("m")).collect():
        assert (r.m if r.m is None else [(m.start, m.end, m.pii_type) for m in r.m]) == cases[r.k][2], cases[r.k]


def test_bytes_that_are_no_text(spark):
    from palisade.operators.detect_text import find_patterns

    bad = spark.range(1).select(F.unhex(F.lit("FF20")).alias("b")).select(F.concat(F.col("b"), F.lit("A1234567").cast("binary")).cast("string").alias("t"))
    assert [[(m.start, m.text) for m in r.m] for r in bad.select(find_patterns(F.col("t")).alias("m")).collect()] == [[(2, "A1234567")]]


def test_addresses_are_found_with_one_pattern(spark):
    from palisade.operators.detect_text import sanitize_urls

    texts = ["a HTTP://U:p@X.org:80/a?b http://x.org, http://x.org http://x.orgs", "http:// https://", "é😀 https://h:1/'https://h:1/b", "none", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", sanitize_urls(F.col("t")).alias("s"))
    assert "(.*?)" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.s for r in sorted(rows.collect())] == ["a http://x.org http://x.org, http://x.org http://x.orgs", "http:// https://", "é😀 https://h:1'https://h:1", "none", "", None]
