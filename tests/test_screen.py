"""Detection over elements, words and lines of a screen."""

import pytest
from pyspark.sql import functions as F

ELEMENTS = "page_id long, element_id string, n int, x double, role string, name string, text string, value string, placeholder string, field_name string, input_type string, autocomplete string, label string, ocr_text string, confidence double"
WORDS = "page_id long, n int, text string, x double, y double, width double, height double, confidence double"
VAULT = "page_id long, seq long, pii_type string, value string, slot string"
CARD, AADHAAR = "4111111111111111", "4321 8765 2109"


def element(page, n, name="", text=None, value=None, placeholder=None, field=None, kind=None, auto=None, label=None, ocr=None):
    return page, f"el_{n}", n, 200.0 * n, "generic", name, text, value, placeholder, field, kind, auto, label, ocr, 0.8


def run(spark, elements=(), read=(), vault=()):
    from palisade.functions.geometry import rect
    from palisade.operators import screen
    from palisade.sources.stored import stored

    own = spark.createDataFrame(list(elements), ELEMENTS).withColumn("rect", rect(F.col("x"), F.lit(0), F.lit(180), F.lit(24)))
    read = [tuple(float(v) if k > 2 else v for k, v in enumerate(w)) for w in read]
    found = stored(screen.detections(own, spark.createDataFrame(read, WORDS), spark.createDataFrame(list(vault), VAULT)), "all")
    kept = stored(screen.findings(found), "kept")
    rows = {(r.page_id, r.pii_type, r.location, r.field, r.start, r.end): r for r in kept.collect()}
    return rows, {(r.page_id, r.kind, r.name): r.n for r in screen.stats(found, kept).collect()}


@pytest.fixture(scope="module")
def seen(spark):
    read = [
        (1, 0, CARD, 10, 10, 80, 12, 0.3), (1, 1, "4321", 10, 40, 40, 12, 0.9), (1, 2, "2109", 110, 41, 40, 12, 0.7), (1, 3, "8765", 60, 40, 40, 12, 0.8),
        (2, 0, "sk_live_", 10, 10, 60, 12, 1.0), (2, 1, "abcDEF1234567890xyz", 80, 10, 60, 12, 1.0), (3, 0, "asha@x.org", 5, 5, 50, 10, 0.2), (3, 1, "asha@x.org", 5, 50, 50, 10, 1.0),
        (21, 0, "CS1234", 5, 5, 50, 10, 0.9), (21, 1, "other", 5, 90, 50, 10, 0.9),
    ]
    elements = [
        element(11, 0, "Card", value=CARD, auto="cc-number", kind="text"), element(11, 1, "Phone number", kind="text", auto="email"), element(11, 2, label="a human face"),
        element(11, 3, f"see {CARD}", text=f"see {CARD}"), element(11, 4, placeholder=f"e.g. {CARD}"), element(11, 5, ocr=f"{AADHAAR} read"),
        element(21, 0, "Roll number", text="CS-1234"), element(21, 1, text="marks of cs 1234 and CS-1234"), element(21, 2, "CS/1234"), element(22, 0, text="CS-1234"),
        element(23, 0, text="राम कुमार here"), element(23, 1, "RAO, ASHA RAO"),
    ]
    vault = [(23, 0, "person_name", "राम कुमार", "hi"), (23, 1, "person_name", "Asha Rao", "en"), (23, 2, "person_name", "Asha", "short")]
    return run(spark, elements, read, vault)


def test_words_and_lines(seen):
    rows, stats = seen
    # half the confidence at least, in the word's own box
    assert abs(rows[1, "credit_card", "ocr:10:10:80:12", None, None, None].confidence - 0.95 * 0.5) < 1e-9
    # words of a line in reading order: with spaces and without
    line = "ocr:10:40:140:13"
    assert abs(rows[1, "aadhaar", line, "ocr", 0, 14].confidence - 0.96 * 0.8) < 1e-9 and rows[1, "aadhaar", line, "ocr", 0, 12].matched_text == "432187652109"
    assert any(k[1] == "api_key" and k[3] == "ocr" and k[5] == 27 for k in rows if k[0] == 2)  # found without the space alone
    # a weak reading of an address is below its threshold, though its copy confirms it: half of the confidence
    assert (3, "email", "ocr:5:50:50:10", None, None, None) in rows and (3, "email", "ocr:5:5:50:10", None, None, None) not in rows
    # a place in a word, the same in its line, and the word once more for the value confirmed
    assert stats[3, "below", ""] == 2 and stats[1, "detector", "pattern"] == 5 and stats[1, "type", "credit_card"] == 2


def test_elements_fuse_and_conflict(seen):
    rows, stats = {(k[0], *k[1:]): r for k, r in seen[0].items() if k[0] == 11}, seen[1]
    assert rows[11, "credit_card", "el_0", None, None, None].detectors == ["structural"] and rows[11, "credit_card", "el_0", "value", 0, 16].confidence == 0.95
    assert [r.conflicting for k, r in rows.items() if k[2] == "el_1"] == [True, True] and stats[11, "conflicts", ""] == 1
    assert rows[11, "face", "el_2", None, None, None].redaction == "blur" and rows[11, "credit_card", "el_3", "name", 4, 20].rect.width == 180.0
    assert rows[11, "credit_card", "el_3", "text", 4, 20].rect.width < 180.0 and rows[11, "credit_card", "el_4", "placeholder", 5, 21].rect.width == 180.0
    assert (11, "aadhaar", "el_5", "ocr", 0, 14) in rows
    assert [r.rank for r in sorted(rows.values(), key=lambda r: (-r.confidence, r.seq, r.start or 0))] == list(range(1, len(rows) + 1))


def test_values_go_everywhere_once_confirmed(seen):
    rows, stats = seen
    places = {k[2:] for k in rows if k[:2] == (21, "roll_number")}
    assert places == {
        ("el_0", None, None, None), ("el_0", "text", 0, 7), ("el_1", "text", 9, 16), ("el_1", "text", 21, 28), ("el_2", "name", 0, 7), ("ocr:5:5:50:10", None, None, None),
    }
    assert rows[21, "roll_number", "el_1", "text", 9, 16].confidence == 0.72 and not [k for k in rows if k[0] == 22]
    assert rows[23, "person_name", "el_0", "text", 0, 9].slot == "hi" and rows[23, "person_name", "el_1", "name", 5, 13].detectors == ["known_value"]
    assert len([k for k in rows if k[0] == 23]) == 2 and stats[23, "detector", "known_value"] == 2


def test_nothing_to_see(spark):
    assert run(spark) == ({}, {})


def test_no_side_of_a_page_join_is_broadcast(spark, tmp_path):
    from palisade.queries import QUERIES

    spark.range(40).select(F.col("id").alias("c_custkey")).write.parquet(f"file://{tmp_path}/customer.parquet")
    found = QUERIES["screen_findings"](spark, f"file://{tmp_path}")
    assert found.count() > 40 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
