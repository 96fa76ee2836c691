"""Detectors, geometry, plans and replies on small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "found"), [
    ("mail A.b@c.org now", [("email", "A.b@c.org")]), ("", []), ("card 4111 1111 1111 1111.", [("credit_card", "4111 1111 1111 1111")]), ("card 4111 1111 1111 1112", []),
    ("éabcde1234f ABCPE1234F", [("pan", "ABCPE1234F")]), ("27ABCPE1234F1Z5 here", [("gstin", "27ABCPE1234F1Z5")]), ("roll no CS-1234", [("roll_number", "CS-1234")]),
    ("CS-1234 alone", []), ("dob 01/02/1999", [("date_of_birth", "01/02/1999")]), ("😀 otp 4821", [("otp", "4821")]), ("ab@okaxis b", [("upi_id", "ab@okaxis")]),
])
def test_patterns(spark, text, found):
    from palisade.operators.detect_text import find_patterns

    got = one(spark, find_patterns(F.col("t")), t=text)
    assert [(m["pii_type"], m["text"]) for m in got] == found
    assert all(text[m["start"] : m["end"]] == m["text"] for m in got)


def test_verhoeff_finds_every_single_error(spark):
    from palisade.functions.checksum import is_aadhaar

    rows = [(f"23456789012{d}",) for d in range(10)]
    good = [r.v for r in spark.createDataFrame(rows, "v string").where(is_aadhaar(F.col("v"))).collect()]
    assert len(good) == 1
    wrong = [(good[0][:k] + str((int(good[0][k]) + 1) % 10) + good[0][k + 1 :],) for k in range(1, 12)]
    swapped = [(good[0][:k] + good[0][k + 1] + good[0][k] + good[0][k + 2 :],) for k in range(1, 11)]
    swapped = [s for s in swapped if s[0] != good[0]]
    assert spark.createDataFrame(wrong + swapped, "v string").where(is_aadhaar(F.col("v"))).count() == 0


def test_sanitised_text_keeps_nothing_found(spark):
    from palisade.operators.detect_text import sanitized

    text = "my password is Hunter2Hunter2, mail me@x.org at https://Site.example:8443/a?b"
    got = one(spark, sanitized(F.col("t")), t=text)
    assert "Hunter2" not in got and "me@x.org" not in got and "/a?b" not in got and "<HIDDEN_PASSWORD>" in got and got.endswith("https://site.example:8443")
    assert one(spark, sanitized(F.col("t")), t="plain words") == "plain words"


def test_known_values(spark):
    from palisade.operators.detect_text import known_matches

    texts = spark.createDataFrame([(1, "Ram lives in Rampur; Ram Kumar 4321 8765-2109 x"), (2, "nothing"), (3, None)], "k long, text string")
    known = spark.createDataFrame([("person_name", "Ram Kumar", "a"), ("aadhaar", "432187652109", "b"), ("person_name", "Ram", "c")], "pii_type string, value string, slot string")
    got = {(r.k, r.slot, r.text) for r in known_matches(texts, known, "text", ["k"]).collect()}
    assert got == {(1, "a", "Ram Kumar"), (1, "b", "4321 8765-2109")}


def test_union_area_against_a_grid(spark):
    from palisade.functions.geometry import rect
    from palisade.operators.redact import union_areas

    rnd = random.Random(3)
    rows = [(p, rnd.randrange(30), rnd.randrange(30), rnd.randrange(0, 12), rnd.randrange(0, 12)) for p in range(20) for _ in range(8)]
    table = spark.createDataFrame(rows, "page long, x int, y int, w int, h int").select("page", rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("r"))
    got = {r.page: r.area for r in union_areas(table, "page").collect()}
    for p in range(20):
        cells = {(a, b) for q, x, y, w, h in rows if q == p for a in range(x, x + w) for b in range(y, y + h)}
        assert got.get(p, 0) == len(cells)


def test_merged_regions(spark):
    from palisade.functions.geometry import rect
    from palisade.operators.redact import merged

    rows = [(1, 0, 0, 0, 10, 10, "a"), (1, 1, 14, 0, 10, 10, "b"), (1, 2, 29, 0, 5, 5, "c"), (1, 3, 100, 100, 5, 5, "a"), (1, 4, 30, 0, 5, 5, "z")]
    table = spark.createDataFrame(rows, "page long, n int, x int, y int, w int, h int, pii_type string")
    table = table.select("page", "n", F.when(F.col("n") == 4, "blur").otherwise("mask").alias("mode"), rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("r"), "pii_type")
    got = {(r.mode, r.x, r.y, r.width, r.height, r.pii_types) for r in merged(table, "page", "mode", "n").collect()}
    assert got == {("mask", 0.0, 0.0, 34.0, 10.0, "a,b,c"), ("mask", 100.0, 100.0, 5.0, 5.0, "a"), ("blur", 30.0, 0.0, 5.0, 5.0, "z")}


@pytest.mark.parametrize(("reply", "found"), [
    ('x {"a": "}"} y', '{"a": "}"}'), ("```json\n[1, 2]\n```", "[1, 2]"), ('{"a": [1, {"b": 2', '{"a": [1, {"b": 2}]}'), ('{"a": "cut', '{"a": "cut"}'), ("none", None), (None, None), ('{"a": nope', None),
])
def test_json_in_replies(reply, found):
    from palisade.operators.replies import find_json

    assert find_json(reply) == found


def test_walker():
    from palisade.sources.pages import walk

    rows = walk("<html><head><title>t</title><script>'<p>'</script></head><body><nav hidden><a href=x>one</a></nav><form><label for=q>Name</label><input id=q name=n></form><p>a<p>b <b>c")
    assert [r[3] for r in rows if r[3] not in ("html", "body")] == ["nav", "a", "form", "label", "input", "p", "p", "b"]
    assert rows[-2][6] == "b c" and [r[7] for r in rows if r[3] == "a"] == [True]


def test_audit_hides_values(spark):
    from palisade.plans import audit

    html = "<body><h1>Hello</h1><button>Send to me@x.org</button><p>dob 01/02/1999 and me@x.org</p><input name='email' type='email' value='me@x.org'></body>"
    pages = spark.createDataFrame([(1, "https://a.example/x?y", html), (2, "https://b.example", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in audit.packets(pages).collect()}
    assert "me@x.org" not in got[1].packet and "1999" not in got[1].packet and '"origin":"https://a.example"' in got[1].packet
    assert got[1].n_findings >= 3 and got[2].n_nodes == 0


def test_entry_and_names(spark):
    import __spark_entry__ as e

    queries, oracle = e.queries(), e.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 40
    assert not [n for n in oracle if not re.match(r"\w+$", n)]


def test_routes_of_all_orders(spark, tmp_path):
    from datetime import datetime

    from palisade.operators import store
    from palisade.queries import QUERIES

    rows = [(k, k % 9, datetime(2024, 1, 1 + k % 28)) for k in [*range(1, 60), *range(3990, 4100)]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(20)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    from palisade.queries import store as queries

    words = lambda g: {w for w in re.findall("[a-z0-9]+", g.lower()) if len(w) > 2}
    share = lambda a, b: len(words(a) & words(b)) / min(len(words(a)), len(words(b)))
    routes = [r.asDict() for r in queries.routes(spark, str(tmp_path)).collect()]
    assert len(routes) == len(rows)
    best = {}
    for k in range(20):
        own = [(share("please " + queries._GOALS[k % 5], r["goal"]), r["saved_at"], r["route"]) for r in routes if r["origin"] == f"https://s{k % 60}.example"]
        if own and max(own)[0] >= store.LEAST_OVERLAP:
            best[k] = max(own)[2]
    assert {r.k: r.route for r in QUERIES["recalled_routes"](spark, str(tmp_path)).collect()} == best and max(best.values()) > 4000
    left = [r for r in routes if not any(o["origin"] == r["origin"] and o["saved_at"] > r["saved_at"] and share(o["goal"], r["goal"]) >= store.LEAST_OVERLAP for o in routes)]
    left.sort(key=lambda r: (-r["saved_at"], r["route"]))
    got = [(r.place, r.route, r.steps) for r in QUERIES["remembered_routes"](spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [(n + 1, r["route"], min(r["steps"], 24)) for n, r in enumerate(left[:40])]


def test_downloads_and_stray_events(spark):
    from palisade.operators.session import download_outcomes

    cases = {
        1: ([("a", 500, "complete"), ("a", 1500, "created"), ("a", 2500, "complete")], "complete"), 2: ([("a", 500, "complete"), ("a", 1500, "created")], "failed"),
        3: ([], "none"), 4: ([("a", 4000, "created"), ("a", 4100, "complete")], "none"), 5: ([("a", 10, "created"), ("a", 20, "interrupted"), ("b", 30, "created"), ("b", 900, "complete")], "complete"),
        6: ([("a", 1100, "created"), ("a", 1200, "interrupted"), ("b", 1150, "created"), ("b", 1300, "complete")], "failed"), 7: ([("a", 1100, "created"), ("a", 70_000, "complete")], "failed"),
    }
    waits = spark.createDataFrame([(k, 1000) for k in cases], "k long, at_ms long")
    events = spark.createDataFrame([(k, *e) for k, (es, _) in cases.items() for e in es], "k long, id string, at_ms long, kind string")
    assert {r.k: r.outcome for r in download_outcomes(waits, events).collect()} == {k: o for k, (_, o) in cases.items()}
