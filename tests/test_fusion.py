"""Regions and elements joined by place, against plain loops."""

import random


def _data(seed=3):
    rnd = random.Random(seed)
    rect = lambda: (float(rnd.randrange(0, 60)), float(rnd.randrange(0, 60)), float(rnd.randrange(-2, 40)), float(rnd.randrange(-2, 40)))
    elements = [(p, k, rect(), rnd.random() < 0.2) for p in range(40) for k in range(5)]
    regions = [(p, k, rect(), rnd.randrange(3) / 2) for p in range(40) for k in range(6)]
    return elements, regions


_RECT = "struct<x double, y double, width double, height double>"


def _area(r):
    return max(r[2], 0) * max(r[3], 0)


def _inter(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def _match(r, er):
    both = _inter(r, er)
    union = _area(r) + _area(er) - both
    return (union > 0 and both / union >= 0.45) or (_area(r) > 0 and both / _area(r) >= 0.75)


def _frames(spark):
    elements, regions = _data()
    return spark.createDataFrame(elements, f"page_id long, element long, er {_RECT}, hidden boolean"), spark.createDataFrame(regions, f"page_id long, n long, r {_RECT}, score double")


def _best(elements, regions):
    found = {}
    for p, n, r, _ in regions:
        near = [(_area(er), k) for q, k, er, hidden in elements if q == p and not hidden and _match(r, er)]
        if near:
            found[p, n] = min(near)[1]
    return found


def test_matches_owners_and_fused_against_loops(spark):
    from palisade.operators import fusion

    elements, regions = _data()
    e, r = _frames(spark)
    best = _best(elements, regions)
    assert {(x.page_id, x.n): x.element for x in fusion.best_match(r, e).collect()} == best
    owned = {}
    for p, n, box, _ in regions:
        near = [(_area(er), k) for q, k, er, _ in elements if q == p and _area(er) > 0 and _area(box) > 0 and _inter(box, er) / _area(box) >= 0.6]
        if near:
            owned[p, n] = min(near)[1]
    assert {(x.page_id, x.n): x.element for x in fusion.owners(r, e).collect()} == owned
    want = []
    for p, k, _, _ in elements:
        scores = [s for q, n, _, s in regions if q == p and best.get((p, n)) == k]
        want.append((p, f"el_{k}", "fused" if scores else "structure", max(scores, default=1.0)))
    for p in range(40):
        alone = sorted((-s, n, box) for q, n, box, s in regions if q == p and (p, n) not in best and _area(box) >= 120)
        left = [x for i, x in enumerate(alone) if not any(_match(x[2], y[2]) for y in alone[:i])]
        want += [(p, f"px_{i}", "pixel", -s) for i, (s, _, _) in enumerate(left)]
    assert sorted(map(tuple, fusion.fuse(e, r).collect())) == sorted(want)


def test_conditions_of_joins_read_plain_columns(spark):
    from palisade.operators import fusion

    e, r = _frames(spark)
    for pairs in (fusion.best_match(r, e), fusion.owners(r, e)):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        join = next(line for line in plan.splitlines() if "Join Inner" in line)
        assert "i_l" in join and ".x" not in join and "named_struct" not in join
