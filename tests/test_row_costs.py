"""Work by the row that is done once, with the same results."""

from pyspark.sql import functions as F


def test_matches_found_without_a_second_pattern(spark):
    from palisade.functions.spans import find_all
    from palisade.operators.detect_text import search_pattern

    texts = ["1234 5678-9012", "x12345678901 123456789012, 1234-5678 9012 123456789012", "é😀 1234567 89012!", "", None, "123456789012123456789012", "aBCde ABCDE abcd-e"]
    rows = spark.createDataFrame([(t, v, k) for t in texts for v, k in (("123456789012", "aadhaar"), ("abcde", "pan"), ("12", "pan"))], "text string, value string, kind string")
    rx = search_pattern(F.col("kind"), F.col("value"))
    got = rows.select("text", find_all(F.col("text"), rx).alias("usual"), find_all(F.col("text"), rx, alone=True).alias("alone")).collect()
    assert all((r.usual or []) == (r.alone or []) for r in got)
    assert sum(len(r.alone or []) for r in got) > 8
    assert all(r.text[m.start : m.end] == m.text for r in got for m in r.alone or [])


def test_only_the_kinds_asked_for_are_made(spark, tmp_path):
    from palisade.sources import derived

    path = f"file://{tmp_path}"
    spark.range(50).select(F.col("id").alias("o_orderkey")).write.parquet(f"{path}/orders.parquet")
    some, every = derived.id_candidates(spark, path, ("aadhaar", "card")), derived.id_candidates(spark, path)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.where("kind in ('aadhaar', 'card')").collect()))
    assert "GSTIN" not in some._jdf.queryExecution().optimizedPlan().toString().upper()


def test_downloads_are_dealt_by_their_number(spark, monkeypatch):
    from palisade.operators import session

    monkeypatch.setattr(session, "TASK_EVENTS", 20, raising=False)
    waits = spark.range(300).select(F.col("id").alias("k"), F.lit(1000).alias("at_ms"))
    events = waits.where("k % 3 > 0").select("k", F.lit(1).alias("id"), F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(ms).alias("at_ms")) for n, ms in (("created", 1500), ("complete", 1600))])))
    out = session.download_outcomes(waits, events)
    assert out.rdd.getNumPartitions() >= 20
    assert {(r.k, r.outcome) for r in out.collect()} == {(k, "complete" if k % 3 else "none") for k in range(300)}


def _least(parsed) -> list[str]:
    """Texts of a parsed pattern: each choice, each repeat as seldom as it may be and once more."""
    from itertools import product

    def one(op, av) -> list[str]:
        name = str(op)
        if name == "LITERAL":
            return [chr(av)]
        if name == "IN":
            kind, first = av[0]
            return [chr(first)] if str(kind) == "LITERAL" else [" "]
        if name == "AT":
            return [""]
        if name == "BRANCH":
            return [t for choice in av[1] for t in _least(choice)]
        if name == "SUBPATTERN":
            return _least(av[3])
        assert name == "MAX_REPEAT", name
        few = av[0]
        item = _least(av[2])
        return ["".join(p) for n in (few, few + 1) for p in product(item, repeat=n)]

    return ["".join(p) for p in product(*[one(op, av) for op, av in parsed])]


def test_every_match_of_a_label_rule_holds_one_of_its_words():
    import re

    from palisade.taxonomy import LABEL_RULES

    for r in LABEL_RULES:
        texts = _least(re._parser.parse(r.pattern))
        assert r.words and all(any(w in t for w in r.words) for t in texts), (r.pii_type, [t for t in texts if not any(w in t for w in r.words)][:5])
        assert all(re.search(r.pattern, t, re.I) for t in texts)


def test_wanted_types_find_signals_once_and_as_before(spark, tmp_path):
    from palisade.functions.dialect import java
    from palisade.operators.fields import label_signal
    from palisade.queries import QUERIES
    from palisade.taxonomy import LABEL_RULES

    spark.createDataFrame([(k, k % 7, f"name {k}") for k in range(60)], "p_partkey long, p_size int, p_name string").write.parquet(f"file://{tmp_path}/part.parquet")
    wanted = QUERIES["wanted_types"](spark, f"file://{tmp_path}")
    # a rule's pattern stands in the plan once
    assert wanted._jdf.queryExecution().optimizedPlan().toString().count("gst(?:in)?") == 1
    said = ["APIKey", "D.O.B", "DO.B", "Driver's Licence", "A/C no", "uid", "uidx", "Spouse's NAME", "e-mail", "Éphone", "PIN code", "regd id", "Key api", None, ""]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", label_signal(F.col("t"), F.lit(""), F.lit(""))["pii_type"].alias("got"), *[F.col("t").rlike(java(r.pattern, True)).alias(f"r{i}") for i, r in enumerate(LABEL_RULES)])
    for r in rows.collect():
        assert r.got == next((x.pii_type for i, x in enumerate(LABEL_RULES) if r[f"r{i}"]), None), r.t


def test_lines_of_a_screen_are_put_together_once(spark, tmp_path):
    from palisade.queries import QUERIES

    spark.range(40).select(F.col("id").alias("c_custkey")).write.parquet(f"file://{tmp_path}/customer.parquet")
    plan = QUERIES["screen_findings"](spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
