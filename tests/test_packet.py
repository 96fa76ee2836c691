"""Packets: the order of substitutions, tokens that leak, survivors, the catalogue."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from test_known import LOOSE, plain


def fold(known):
    """Substitutions as a plain loop: known is [(source, seq, type, literal, token)]."""
    by = {}
    for source, _, kind, literal, token in sorted(known, key=lambda r: r[:2]):
        literal = literal.strip()
        if len(literal) < 5 or (source == 0 and token == ""):
            continue
        if source == 0 or (kind, literal) not in by:
            by[kind, literal] = token
    rewrites, n = {}, 0
    for (kind, _), token in by.items():
        if any((rx := plain(kind, other)) and rx.search(token) for _, other in by):
            rewrites[token] = f"{kind.upper()}_{n}"
            n += 1
    esc = lambda s: re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s)

    def length(kind, value):
        if kind in LOOSE:
            bare = re.sub(r"[\s\-/.()]", "", value)
            return len(esc(bare)) + 9 * (len(bare) - 1)
        return len(esc(value)) + 2 * bool(re.match(r"[A-Za-z0-9_]", value)) + 2 * bool(re.search(r"[A-Za-z0-9_]\Z", value))

    out = [(plain(kind, literal), rewrites.get(token, token), length(kind, literal)) for (kind, literal), token in by.items()]
    out = sorted((x for x in out if x[0]), key=lambda x: -x[2])
    return [x[:2] for x in out] + [(re.compile(re.escape(a), re.I), b) for a, b in rewrites.items()]


def scrub(text, subs):
    for rx, to in subs:
        text = rx.sub(lambda m: to, text)  # noqa: B023
    return text


def scrubbed(spark, known, texts):
    from palisade.operators import session

    subs = session.substitutions(spark.createDataFrame([("g", *k) for k in known], "grp string, source int, seq long, pii_type string, literal string, token string"))
    rows = spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)], "grp string, k int, t string").join(subs, "grp", "left")
    return [r.x for r in rows.select("k", F.coalesce(session.scrubbed(F.col("t"), F.col("substitutions")), F.col("t")).alias("x")).orderBy("k").collect()]


def test_a_token_may_not_hold_a_literal_of_another_type(spark):
    known = [(2, 0, "person_name", "21CS042", "PERSON_NAME_SELF"), (2, 1, "roll_number", "99XY777", "ROLL_NUMBER_21CS042")]
    said = scrubbed(spark, known, ["my roll 99xy-777", "token ROLL_NUMBER_21CS042", "21CS042"])
    assert said == ["my roll ROLL_NUMBER_0", "token ROLL_NUMBER_0", "PERSON_NAME_SELF"]


def test_two_literals_under_one_leaking_token_get_one_name(spark):
    known = [(1, 0, "roll_number", "21CS042", "ROLL_NUMBER_21CS042"), (2, 1, "roll_number", "77EE001", "ROLL_NUMBER_21CS042")]
    assert scrubbed(spark, known, ["21CS042 and 77EE001"]) == ["ROLL_NUMBER_1 and ROLL_NUMBER_1"]


def test_substitutions_against_a_plain_loop(spark):
    from palisade.operators import session

    rnd = random.Random(7)
    values = ["Asha Rao", "Asha Rao Verma", "21CS042", "4321 8765 2109", "432187652109", "asha@x.org", "x (1) y$", "Rao Verma", " Asha Rao ", "abc"]
    kinds = ["person_name", "roll_number", "aadhaar", "email"]
    every, texts, expected = [], [], {}
    for g in range(40):
        known = []
        for k in range(rnd.randrange(1, 9)):
            kind, value = rnd.choice(kinds), rnd.choice(values)
            known.append((rnd.randrange(3), k, kind, value, rnd.choice([f"{kind.upper()}_{rnd.choice('ab')}".upper(), f"{kind.upper()}_{value}", ""])))
        every += [(str(g), *k) for k in known]
        subs = fold(known)
        for k in range(6):
            t = " ".join(rnd.choice([*values, "and", "ROLL_NUMBER_21CS042", "21-CS-042", "ASHA  RAO"]) for _ in range(8))
            texts.append((str(g), k, t))
            expected[str(g), k] = scrub(t, subs)
    subs = session.substitutions(spark.createDataFrame(every, "grp string, source int, seq long, pii_type string, literal string, token string"))
    rows = spark.createDataFrame(texts, "grp string, k int, t string").join(subs, "grp", "left")
    assert {(r.grp, r.k): r.x for r in rows.select("grp", "k", F.coalesce(session.scrubbed(F.col("t"), F.col("substitutions")), F.col("t")).alias("x")).collect()} == expected


NODES = "page_id long, element_id string, n int, role string, name string, text string, problem string, options array<string>, hidden boolean, interactive boolean, editable boolean"
FOUND = "page_id long, seq long, element_id string, field string, start int, end int, pii_type string, confidence double, redaction string, slot string, matched_text string, replacement string, conflicting boolean"
VAULT = "page_id long, seq long, pii_type string, value string, slot string"


def build(spark, nodes, titles, found, vault, with_text=True):
    from palisade.operators import packet

    out = packet.built(
        spark.createDataFrame(nodes, NODES), spark.createDataFrame(titles, "page_id long, title string"), spark.createDataFrame(found, FOUND), spark.createDataFrame(vault, VAULT), with_text
    )
    own, title, withheld, offers = out
    return (
        {(r.page_id, r.element_id): r for r in own.collect()}, {r.page_id: r.title for r in title.collect()}, {(r.page_id, r.path): r.pii_type for r in withheld.collect()},
        {r.page_id: [tuple(p) for p in r.placeholders] for r in offers.collect()},
    )


def node(page, n, name="", text=None, problem=None, options=None, hidden=False, interactive=False, editable=False):
    return page, f"el_{n}", n, "generic", name, text, problem, options, hidden, interactive, editable


def test_edits_sweep_and_survivors(spark):
    nodes = [
        node(1, 0, "Asha Rao", "Hello Asha Rao, roll 21CS042"), node(1, 1, "Raomanner", None, "21cs-042 is not registered", ["Asha Rao", "other"], interactive=True),
        node(1, 2, hidden=True, text="21CS042"), node(1, 3), node(1, 4, "see AshaRaoX", "fine"), node(2, 0, "Asha Rao", "21CS042 stays: another page"),
    ]
    found = [
        (1, 0, "el_0", "text", 6, 14, "person_name", 0.9, "synthetic", None, "Asha Rao", "Xxxx Xxx", False),
        (1, 1, None, None, None, None, "person_name", 0.8, "synthetic", None, "AshaRao", None, True),
    ]
    vault = [(1, 0, "roll_number", "21CS042", "main"), (1, 1, "otp", "482199", "now")]
    own, title, withheld, offers = build(spark, nodes, [(1, "Marks — Asha Rao (21CS042)"), (2, "Other")], found, vault)
    assert own[1, "el_0"].text == "Hello Xxxx Xxx, roll ROLL_NUMBER_MAIN" and own[1, "el_0"].name == "Xxxx Xxx" and own[1, "el_0"].sensitive
    assert own[1, "el_1"].problem == "ROLL_NUMBER_MAIN is not registered" and own[1, "el_1"].options == ["Xxxx Xxx", "other"] and own[1, "el_1"].name == "Raomanner"
    # the sweep has word boundaries for names, the last check has none: the field is withheld
    assert withheld == {(1, "nodes[el_4].name"): "person_name"} and own[1, "el_4"].name == "" and own[1, "el_4"].text == "fine"
    assert (1, "el_2") not in own and (1, "el_3") not in own
    assert title == {1: "Marks — Xxxx Xxx (ROLL_NUMBER_MAIN)", 2: "Other"} and own[2, "el_0"].text == "21CS042 stays: another page"
    assert offers == {1: [("ROLL_NUMBER_MAIN", "roll_number", 7, True)]}


def test_title_and_structure_only(spark):
    nodes = [node(1, 0, "Pay now", "body", interactive=True), node(1, 1, "Heading", "prose", "wrong", ["a"])]
    found = [(1, 0, None, None, None, None, "email", 0.9, "placeholder", None, "a@b.example", None, False)]
    own, title, withheld, _ = build(spark, nodes, [(1, "for xa@b.examplex")], found, [])
    assert title == {1: ""} and withheld == {(1, "packet.title"): "email"} and own[1, "el_0"].text == "body"
    own, title, withheld, _ = build(spark, nodes, [(1, "for xa@b.examplex")], found, [], with_text=False)
    assert title == {1: ""} and withheld == {} and own[1, "el_0"].name == "Pay now" and own[1, "el_0"].text is None
    assert own[1, "el_1"].name == "" and own[1, "el_1"].text is None and own[1, "el_1"].problem is None and own[1, "el_1"].options == ["a"]


def test_catalogue_lists_a_value_once_under_a_safe_token(spark):
    found = [(1, 0, "el_0", "text", 0, 7, "roll_number", 1.0, "synthetic", "21CS042", "21CS042", "ROLL_NUMBER_21CS042", False)]
    vault = [(1, 0, "roll_number", "21CS042", "21CS042"), (1, 1, "email", "asha@x.org", "a"), (1, 2, "cvv", "12345", "c")]
    own, _, withheld, offers = build(spark, [node(1, 0, "", "21CS042 here")], [(1, "")], found, vault)
    # the literal goes where the edit has put it, too: patterns of identifiers have no word boundaries
    assert own[1, "el_0"].text == "ROLL_NUMBER_ROLL_NUMBER_0 here" and withheld == {}
    assert offers == {1: [("ROLL_NUMBER_ROLL_NUMBER_0", "roll_number", 7, True), ("EMAIL_A", "email", 10, True)]}


@pytest.mark.parametrize("with_text", [True, False])
def test_whole_pages(spark, with_text):
    from palisade.plans import audit

    html = "<title>Mail  of\nme@x.org</title><body><h1>Hi</h1><p>me@x.org or 4321-8765-2108</p><button>Write me@x.org</button><div style='display:none'>me@x.org</div><input type=email name=email value='me@x.org'></body>"
    pages = spark.createDataFrame([(1, "https://a.example/x?me@x.org", html), (2, None, None)], "page_id long, url string, html string")
    vault = spark.createDataFrame([(1, 0, "aadhaar", "432187652108", "own")], VAULT)
    got = {r.page_id: r for r in audit.packets(pages, vault, with_text).collect()}
    assert "me@x.org" not in got[1].packet and "8765" not in got[1].packet
    p = json.loads(got[1].packet)
    assert p["origin"] == "https://a.example" and {x["token"] for x in p["placeholders"]} == {"AADHAAR_OWN"} and got[1].bytes == len(got[1].packet.encode())
    assert p["title"].startswith("Mail of ") if with_text else p["title"] == ""
    assert any("AADHAAR_OWN" in x.get("text", "") for x in p["nodes"]) == with_text and all("hidden" not in x for x in p["nodes"])
    assert any(x.get("filled") for x in p["nodes"]) and got[2].n_nodes == 0 and json.loads(got[2].packet)["origin"] == "about:blank"
