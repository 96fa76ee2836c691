"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

SCHEMA = "conv_id long, turn long, role string, text string, conv long, key long, place int"
WHITE = " \t\n\x0b\f\r"


def search(rows):
    """Least (cost, audit) over all edits, Dijkstra over (rows done, roles so far by automaton)."""
    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in "0a":
            return cost, audit, out
        allowed = {"0": "su", "s": "u", "u": "a", "a": "u"}[q]
        for x in allowed.replace("s", ""):
            role = {"u": "user", "a": "assistant"}[x]
            heapq.heappush(heap, (cost + 2, audit + "I", i, x, (*out, f"{role}:")))
            if i < len(rows) and rows[i][2] in "-t":
                heapq.heappush(heap, (cost + 2 + (rows[i][2] == "t"), audit + "R", i + 1, x, (*out, f"{role}:{rows[i][1]}")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, out))
            if fault in "-t" and role[:1] and role[:1] in allowed:
                heapq.heappush(heap, (cost + (fault == "t"), audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
    raise AssertionError


def brute(rows, damage):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        convs[conv] += [] if fate == 0 else [(turn is not None, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = set()
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in own:
            said = text.strip(WHITE)
            marked.append((role, text, "b" if not said else "d" if (role, text) in seen else "-" if said[-1] in ".!?" else "t"))
            seen.add((role, text))
        turns = [t for _, t, _, _ in own if t is not None]
        faults = [f for _, _, f in marked]
        initials = [r[:1] for r, _, _ in marked]
        cost, audit, lines = search(marked)
        out.add((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return out


def conversations(seed=1, n=150, most=9):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rnd.randrange(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", "", None])
            text = rnd.choice(["Yes.", "No", "a b c!", "Why?\n ", "", " \t\x0b", None, "é … end", "word " * 40 + "."])
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 1, 3, None]), role, text))
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 7, 8, 9) for r in rows], SCHEMA).repartition(parts)


def test_matches_search(spark):
    from palisade.llm import conversations as C

    rows = conversations()
    for damage in (False, True):
        got = [tuple(r) for r in C.report(frame(spark, rows), damage=damage).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, damage)


def test_conversations_over_many_segments(spark, monkeypatch):
    """One conversation holds most rows: its segments lie in several tasks and are chained."""
    from palisade.llm import conversations as C

    monkeypatch.setattr(C, "SEGMENT_ROWS", 7)
    rnd = random.Random(4)
    rows = [(77, t, rnd.choice(["user", "assistant"] * 4 + ["system", "x"]), rnd.choice(["So.", "Well", f"{t}.", ""])) for t in range(1200)]
    rows += [(78, 2 * t, ["user", "assistant"][t % 2], f"{t}.") for t in range(90)] + conversations(9, 20)
    for damage in (False, True):
        assert {tuple(r) for r in C.report(frame(spark, rows), damage=damage).collect()} == brute(rows, damage)
    by_conv = {}
    for r in C.repaired(frame(spark, rows)).collect():
        by_conv.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    hashes = {c: hashlib.sha256("\n".join(x for _, x in sorted(own)).encode()).hexdigest() for c, own in by_conv.items()}
    assert all(hashes.get(r[0], hashlib.sha256().hexdigest()) == r[-1] for r in brute(rows, False))


def test_weights_of_split_rows_multiply():
    """The best of two segments by their matrices is the best of the whole."""
    from palisade.llm.conversations import end_weight, weights

    rnd = random.Random(6)
    for _ in range(300):
        rows = [(rnd.choice("suax"), rnd.choice("---tbd")) for _ in range(rnd.randrange(0, 12))]
        cut = rnd.randrange(0, len(rows) + 1)
        best = lambda v: min((c + end_weight(q)[0], x + end_weight(q)[1]) for q, (c, x) in v.items())
        joined = {}
        for q, (c, x) in weights(rows[:cut], 0).items():
            for to, (d, y) in weights(rows[cut:], q).items():
                joined[to] = min(joined.get(to, (1 << 30, "")), (c + d, x + y))
        assert best(joined) == best(weights(rows, 0)) == search([(i, "", f) for i, f in rows])[:2]


def test_empty_table_and_lost_conversation(spark):
    from palisade.llm import conversations as C

    assert C.report(spark.createDataFrame([], SCHEMA), damage=True).collect() == []
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = [tuple(r) for r in C.report(frame(spark, [(lost, 0, "user", "Hi.")]), damage=True).collect()]
    assert got == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
