"""Known values in all scripts: index and fold against plain regular expressions."""

import random
import re

from pyspark.sql import functions as F

SPACE = "\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
LOOSE = {"aadhaar", "phone", "roll_number"}


def plain(pii_type, value):
    value = value.strip()
    if len(value) < 5:
        return None
    if pii_type in LOOSE:
        bare = [re.escape(c) for c in re.sub(rf"[{SPACE}\-/.()]", "", value)]
        return re.compile(rf"[{SPACE}\-/.]?".join(bare), re.I) if bare else None
    word = "[A-Za-z0-9_]"
    edge = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return re.compile((edge if re.match(word, value) else "") + re.escape(value) + (edge if re.search(word + r"\Z", value) else ""), re.I)


KNOWN = [
    ("person_name", "राम कुमार", "hi"), ("person_name", "Иван Петров", "ru"), ("person_name", "Zoë Müller-Lüdenscheidt", "de"), ("person_name", "José", "short"), ("person_name", " Ana María ", "es"),
    ("person_name", "ΟΔΥΣΣΕΥΣ", "el"), ("aadhaar", "4321 8765 2109", "a"), ("roll_number", "21CS042", "r"), ("roll_number", "/-. (", "empty"), ("phone", "1-2-3", "few"),
    ("person_name", "the thing", "common"), ("person_name", "李小龙和他的朋友", "zh"), ("person_name", "-----", "dashes"),
]


def test_every_script_is_found(spark):
    from palisade.operators.detect_text import holding_known, known_matches, known_pairs

    rnd = random.Random(1)
    texts = [
        "नाम राम कुमार है", "к ИВАН ПЕТРОВУ и иван петров", "ZOË MÜLLER-LÜDENSCHEIDT!", "xAna María, ana maría.", "οδυσσευς ΟΔΥΣΣΕΥΣ", "43 21-8765.2109 and 21cs-042", "the thing the things", "我认识李小龙和他的朋友们",
        "a ----- b", "1.2.3", None, "", "José",
    ]
    pieces = [v for _, v, _ in KNOWN] + ["the ", "x", " ", "-", "и", "é", "4321"]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    rows = list(enumerate(texts))
    frame, known = spark.createDataFrame(rows, "k long, text string"), spark.createDataFrame(KNOWN, "pii_type string, value string, slot string")
    expected = {(k, slot) for k, t in rows for kind, value, slot in KNOWN if t and (rx := plain(kind, value)) and rx.search(t)}
    assert {(r.k, r.slot) for r in known_pairs(frame, known, "text", ["k"]).collect()} == expected and (0, "hi") in expected
    assert {r.k for r in holding_known(frame, known, "text", ["k"]).collect()} == {k for k, _ in expected}
    places = set()
    for k, t in rows:
        hits = sorted({(m.start() - m.end(), m.start(), m.end(), kind, slot) for kind, value, slot in KNOWN if t and (rx := plain(kind, value)) for m in rx.finditer(t)})
        kept = []
        for h in hits:
            if not any(h[1] < o[2] and o[1] < h[2] for o in kept):
                kept.append(h)
        places |= {(k, a, b, slot) for _, a, b, _, slot in kept}
    assert {(r.k, r.start, r.end, r.slot) for r in known_matches(frame, known, "text", ["k"]).collect()} == places


def test_no_known_values_and_no_texts(spark):
    from palisade.operators.detect_text import known_matches

    texts, none = spark.createDataFrame([(1, "x y z")], "k long, text string"), spark.createDataFrame([], "pii_type string, value string, slot string")
    assert known_matches(texts, none, "text", ["k"]).collect() == [] and known_matches(texts.limit(0), spark.createDataFrame(KNOWN, none.schema), "text", ["k"]).collect() == []


def test_known_values_go_before_shapes_and_labels(spark):
    from palisade.operators.detect_text import sanitized, swept

    rows = [(1, "mail asha@x.org, my name is Asha Rao and more"), (2, "password: hunter22x"), (3, None)]
    known = spark.createDataFrame([("person_name", "asha@x", "s"), ("secret_token", "is Asha", "t")], "pii_type string, value string, slot string")
    out = swept(spark.createDataFrame(rows, "k long, text string"), known, "text", ["k"])
    got = {r.k: r for r in out.withColumn("said", sanitized(F.col("text"), F.col("spans"))).collect()}
    assert [(s.start, s.end, s.source) for s in got[1].spans] == [(5, 11, "known_value"), (25, 32, "known_value")]
    assert got[1].said == "mail <HIDDEN_PERSON_NAME>.org, my name <HIDDEN_SECRET_TOKEN> Rao and more"
    assert got[2].said == "password: <HIDDEN_PASSWORD>" and got[3].said is None


def test_grams_of_texts_are_found_once(spark):
    from palisade.operators import detect_text

    texts = spark.createDataFrame([(1, "Straße Nord 12 and more"), (2, "nothing here"), (3, "12-34 56/78.9 0"), (4, None)], "k long, text string")
    known = spark.createDataFrame([("person_name", "STRASSE nord", "a"), ("pan", "1234567890", "b"), ("email", "absent@x.org", "c")], "pii_type string, value string, slot string")
    found = detect_text.known_candidates(texts, known, "text", ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("LocalRelation")
    # what is joined at last are stored grams: no text is cut into grams again
    assert not any("text#" in part for part in plan)
    assert {(r.k, r.slot) for r in found.collect()} == {(1, "a"), (3, "b")}
