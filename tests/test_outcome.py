"""Ids over observations, and what a step did, against a plain loop."""

import random

import pytest

ELEMENTS = "run long, version long, document long, node long, n int, role string, name string, text string, invalid boolean, message string"
STEPS = "run long, version long, kind string, submits boolean, place string, typed array<long>"
SHOWS_CHANGE = {"click", "click_point", "goto_url", "go_back", "go_forward", "key_press", "scroll"}


def box(run, version, node, n=None, document=0, invalid=False, message=None, role="textbox", name="x", text=None):
    return run, version, document, node, node if n is None else n, role, name, text, invalid, message


def plain(elements, steps):
    """Ids and outcomes by going through each run's observations in order."""
    ids, out, kept = {}, {}, {}
    pages = {}
    for e in sorted(elements, key=lambda e: (e[0], e[1], e[4])):
        pages.setdefault((e[0], e[1]), []).append(e)
        book = ids.setdefault((e[0], e[2]), {})
        book.setdefault(e[3], f"el_{len(book)}")
    for run, version, kind, submits, place, typed in sorted(steps, key=lambda s: s[:2]):
        page = [(ids[(e[0], e[2])][e[3]], e) for e in pages.get((run, version), [])]
        told = [(e[7] if e[7] is not None else e[6] or "").strip()[:200] for _, e in page if e[5] in ("alert", "alertdialog", "status")]
        state = {"place": place, "shape": [(i, e[4], e[5], e[6]) for i, e in page], "bad": {i for i, e in page if e[8]}, "told": {t for t in told if t}}
        was, kept[(run, version)] = kept.get((run, version - 1)), state
        found = (None, None, None)
        if was is not None:
            fresh = [(i, e) for i, e in page if e[8] and i not in was["bad"]]
            news = [t for t in told if t and t not in was["told"]]
            if fresh:
                one = next((f for f in fresh if f[1][3] in (typed or [])), fresh[0])
                found = ("refused", one[0], one[1][9])
            elif news:
                found = ("message", None, news[0])
            elif (kind in SHOWS_CHANGE or (kind == "type" and submits)) and (place, state["shape"]) == (was["place"], was["shape"]):
                found = ("end" if kind == "scroll" else "unchanged", None, None)
        out[(run, version)] = found
    return out


def test_outcomes_equal_a_plain_loop(spark):
    from palisade.operators import outcome

    rng = random.Random(8)
    elements, steps = [], []
    for run in range(25):
        page = list(range(5))
        for version in range(12):
            if rng.random() < 0.4:
                page = rng.sample(range(8), rng.randint(0, 6))
            document = version // 8
            for n, node in enumerate(page):
                role = "status" if node == 7 else "alert" if node == 6 else "textbox"
                text = rng.choice(["saved", " saved ", None, ""]) if node > 5 and rng.random() < 0.3 else None
                elements.append((run, version, document, node, n, role, "e", text, node < 6 and rng.random() < 0.12, rng.choice([None, "no"])))
            steps.append((run, version, rng.choice(["click", "scroll", "type", "select", "hover"]), rng.choice([True, False, None]), f"p{version // 6}", rng.choice([None, [], [2], [4, 1]])))
    got = outcome.outcomes(spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(steps, STEPS)).collect()
    assert {(r.run, r.version): (r.kind, r.element_id, r.said) for r in got} == plain(elements, steps)
    assert {r.kind for r in got} == {None, "refused", "message", "end", "unchanged"}


@pytest.fixture(scope="module")
def told(spark):
    from palisade.operators import outcome

    same = [box(r, v, 0, message="Mail me@x.org is taken", invalid=r == 1 and v == 1) for r in range(1, 6) for v in (0, 1)]
    extra = [box(2, 1, 9, role="alert", name="", text="Session ends soon"), box(None, 1, 1), box(9, None, 1), box(9, 1, None)]
    kinds = {1: "click", 2: "click", 3: "scroll", 4: "go_back", 5: "hover"}
    steps = [(r, v, kinds[r], False, "/a", None) for r in kinds for v in (0, 1)] + [(None, 1, "click", False, "/", None), (8, 1, "click", False, "/", [])]
    found = outcome.outcomes(spark.createDataFrame(same + extra, ELEMENTS), spark.createDataFrame(steps, STEPS))
    return {(r.run, r.version): r for r in outcome.hinted(found).collect()}


def test_hints(told):
    assert told[1, 1].hint.startswith("The page is now refusing el_0: \"Mail <HIDDEN_EMAIL> is taken\". Put something different")
    assert '"Session ends soon"' in told[2, 1].hint and told[3, 1].kind == "end" and told[3, 1].hint.startswith("That scroll did not move")
    assert told[4, 1].hint.startswith("That go back changed nothing") and told[5, 1].hint is None
    # no observation before, none at all, and rows without a run
    assert told[1, 0].kind is None and told[8, 1].kind is None and (None, 1) not in told


def test_registry(spark):
    from palisade.operators import outcome

    rows = [box(1, 0, 0), box(1, 0, 1), box(1, 1, 1), box(1, 2, 0), box(1, 2, 1), box(1, 2, 2), box(1, 3, 0, document=1), box(2, 0, 5)]
    df = spark.createDataFrame(rows, ELEMENTS)
    got = {(r.run, r.version): (r.live, r.minted, r.returned, r.dropped) for r in outcome.registry(df).collect()}
    assert got == {(1, 0): (2, 2, 0, 0), (1, 1): (1, 0, 0, 1), (1, 2): (3, 1, 1, 0), (1, 3): (1, 1, 0, 0), (2, 0): (1, 1, 0, 0)}
    ids = {(r.version, r.node): r.element_id for r in outcome.identified(df).where("run = 1").collect()}
    assert ids == {(0, 0): "el_0", (0, 1): "el_1", (1, 1): "el_1", (2, 0): "el_0", (2, 1): "el_1", (2, 2): "el_2", (3, 0): "el_0"}
    assert outcome.outcomes(spark.createDataFrame([], ELEMENTS), spark.createDataFrame([], STEPS)).count() == 0
