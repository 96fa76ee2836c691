"""Repairing the structure of conversations by weighted finite-state composition.

A conversation is an acceptor of its rows, the edits are a transducer from rows to role initials, and
the allowed orders of roles, ``(s?(ua)+)?``, are an acceptor. The best repair is the shortest path
through their composition under weights (cost, edit labels), compared in that order: adding weights
takes the lesser, multiplying them adds costs and joins labels. That is distributive here, as of two paths
between the same two states with equal costs neither has labels that begin with the other's (what
follows could only be inserts back to the same state, which cost something).

The composition is never built as a whole. Of one row it is a matrix of weights between the four states of the
grammar, with the inserts before the row; only the states that a row is reached in are expanded,
and a matrix is kept for rows of one kind (``row_weights``). Rows come in order, so their product
is the shortest path in topological order; states that cost ``_BEHIND`` more than the best are left,
since the best can do whatever they do for less.

As products are associative, a conversation needn't be in one task. Rows are dealt out by ranges of
(conversation, turn) and cut into segments of a bounded number of rows. A segment that may have others
around it gets its weights from all states to all; these small matrices are then chained in order of the
segments of each conversation, and every segment learns the states that the best path enters
and leaves it in. Only the hash over a whole repaired text must read a conversation in its order; it does
so as a stream of segments.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches

#: Rows, and bytes of text, of a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 1 << 22
#: Costs: of another role, of leaving a row out, of a new row, of a row that ends early.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The grammar (s?(ua)+)?: from each state (start, after s, after u, after a) the state after an initial.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: What inserted and re-roled rows are.
ROLES = {"u": "user", "a": "assistant"}
#: From any state two inserts at most lead behind an assistant's row, where any other state's continuation can be taken up by one edit.
_BEHIND = 2 * INSERT + DELETE
_SPACE = " \t\n\x0b\f\r"

Weight = tuple[int, str]


def _inserted(state: int) -> Iterator[tuple[int, Weight]]:
    """The states that inserts alone reach, none twice."""
    seen, todo = {state}, [(state, (0, ""))]
    while todo:
        q, (cost, labels) = todo.pop(0)
        yield q, (cost, labels)
        for initial, to in GRAMMAR[q].items():
            if initial in ROLES and to not in seen:
                seen.add(to)
                todo.append((to, (cost + INSERT, labels + "I")))


@cache
def row_weights(state: int, initial: str, fault: str) -> tuple[tuple[int, Weight], ...]:
    """(state after, weight) of a row of this kind, entered in this state: inserts, then one edit of
    the row. fault: b(lank), d(uplicate), t(runcated) or -."""
    best: dict[int, Weight] = {}
    more = TRUNCATED if fault == "t" else 0
    for q, (cost, labels) in _inserted(state):
        arcs = [(q, DELETE, "D")]
        if fault not in "bd":
            if initial in GRAMMAR[q]:
                arcs.append((GRAMMAR[q][initial], more, "K"))
            arcs += [(to, REROLE + more, "R") for out, to in GRAMMAR[q].items() if out in ROLES]
        for to, own, label in arcs:
            weight = cost + own, labels + label
            if to not in best or weight < best[to]:
                best[to] = weight
    return tuple(best.items())


@cache
def end_weight(state: int) -> Weight:
    """The inserts that end a conversation in this state."""
    return min(w for q, w in _inserted(state) if q in FINAL)


def _pruned(vector: dict[int, Weight]) -> dict[int, Weight]:
    most = min(c for c, _ in vector.values()) + _BEHIND
    return {q: w for q, w in vector.items() if w[0] <= most}


def weights(rows: list[tuple[str, str]], start: int) -> dict[int, Weight]:
    """rows: (initial, fault). The least weight from ``start`` to each state that may be on a best path."""
    vector: dict[int, Weight] = {start: (0, "")}
    for initial, fault in rows:
        after: dict[int, Weight] = {}
        for q, (cost, labels) in vector.items():
            for to, (own, label) in row_weights(q, initial, fault):
                weight = cost + own, labels + label
                if to not in after or weight < after[to]:
                    after[to] = weight
        vector = _pruned(after)
    return vector


def edited(rows: list[tuple[str, str]], labels: str, state: int) -> Iterator[tuple[str, str, str]]:
    """rows: (role, text). (label, role, text) of each edit from ``state`` on; a deleted row has its own."""
    own = iter(rows)
    for label in labels:
        role, text = ("", "") if label == "I" else next(own)
        if label in "RI":
            initial = next(i for i in GRAMMAR[state] if i in ROLES)
            role = ROLES[initial]
        if label != "D":
            state = GRAMMAR[state][role[:1]]
        yield label, role, text


_STATS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_SEGMENT = [
    ("key", pa.int64()), ("whole", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.string()),
    *((c, pa.int64()) for c in (*_STATS, "low", "high")), ("first", pa.string()), ("last", pa.string()),
    ("paths", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())]))),
]
_SEGMENT_SQL = (
    "key long, whole boolean, roles array<string>, texts array<string>, faults string, blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, high long, first string, last string, paths array<struct<start:int,end:int,cost:long,labels:string>>"
)


class _Segment:
    """Rows of one conversation in order."""

    def __init__(self, conv, number: int):
        self.conv, self.number, self.bytes = conv, number, 0
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[str] = []
        self.turns: list[int | None] = []

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT_ROWS or self.bytes >= SEGMENT_BYTES

    def row(self, key: int, whole: bool) -> tuple:
        initials = [r[:1] for r in self.roles]
        there = [t for t in self.turns if t is not None]
        kinds = list(zip(initials, self.faults, strict=True))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        paths = [
            {"start": s, "end": e, "cost": c, "labels": x}
            for s in ([0] if self.number == 0 and whole else range(len(GRAMMAR))) for e, (c, x) in weights(kinds, s).items()
        ]
        faults = "".join(self.faults)
        return (
            self.conv, key, whole, self.roles, self.texts, faults, faults.count("b"), faults.count("d"), faults.count("t"), illegal,
            len(set(there)), min(there, default=None), max(there, default=None), initials[0], initials[-1], paths,
        )


def _fault(text: str, duplicate: bool) -> str:
    said = text.rstrip(_SPACE)
    return "b" if not said.strip(_SPACE) else "d" if duplicate else "-" if said[-1] in ".!?" else "t"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn, role, text, later) in order -> segments. ``later``: the same role and text
    stand in an earlier turn; equal rows of one turn follow one another. ``whole`` has a segment that surely is its
    conversation: neither the task's first conversation nor its last, and not cut."""
    key, at, kind = TaskContext.get().partitionId() << 40, None, None
    first, previous, done = True, None, []

    def flush(whole: bool) -> None:
        nonlocal key
        done.append(at.row(key, whole))
        key += 1

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *(t for _, t in _SEGMENT)], strict=True)], names=["conv", *(n for n, _ in _SEGMENT)])

    for b in batches:
        kind = b.column(0).type
        held = 0
        for conv, turn, role, text, later in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at is not None and conv != at.conv:
                flush(not first and at.number == 0)
                first, at = False, None
            elif at is not None and at.full():
                flush(False)
                at = _Segment(conv, at.number + 1)
            if at is None:
                at, previous = _Segment(conv, 0), None
            at.add(turn, role, text, _fault(text, later or previous == (turn, role, text)))
            previous = turn, role, text
            held += len(text)
            if held > SEGMENT_BYTES and done:
                held = 0
                yield out()
        if done:
            yield out()
    if at is not None:
        flush(False)
        yield out()


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(begins a conversation, row) of rows in order of conversation."""
    conv, begun = None, False
    for b in batches:
        for r in b.to_pylist():
            yield not begun or r["conv"] != conv, r
            conv, begun = r["conv"], True


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments' weights (conv, key, first, last, low, high, paths) in order -> for each segment (key,
    start, end, illegal, turns): the states in which the best path enters and leaves it, and what is
    to be added to its counts for what stands before it. Of the labels only what the paths
    don't share is held."""
    vector: dict[int, Weight] = {}
    back: list[tuple[int, dict[int, int], int, int]] = []
    last, high = "", None

    def ended() -> pa.RecordBatch:
        q = min(vector, key=lambda q: (vector[q][0] + end_weight(q)[0], vector[q][1] + end_weight(q)[1]))
        rows = []
        for key, starts, illegal, turns in reversed(back):
            rows.append((key, starts[q], q, illegal, turns))
            q = starts[q]
        return pa.RecordBatch.from_pydict(dict(zip(("key", "start", "end", "illegal_before", "turns_before"), (pa.array(c, t) for c, t in zip(
            zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)), strict=True)))

    for begins, r in _by_conversation(batches):
        if begins:
            if back:
                yield ended()
            vector, back, last, high = {0: (0, "")}, [], "", None
        after: dict[int, Weight] = {}
        starts: dict[int, int] = {}
        for p in r["paths"]:
            if p["start"] in vector:
                cost, labels = vector[p["start"]]
                weight = cost + p["cost"], labels + p["labels"]
                if p["end"] not in after or weight < after[p["end"]]:
                    after[p["end"]], starts[p["end"]] = weight, p["start"]
        vector = _pruned(after)
        shared = len(os.path.commonprefix([x for _, x in vector.values()]))
        vector = {q: (c, x[shared:]) for q, (c, x) in vector.items()}
        back.append((r["key"], starts, int(bool(back) and last + r["first"] not in ("su", "ua", "au")), -int(high is not None and high == r["low"])))
        last, high = r["last"], r["high"] if r["high"] is not None else high
    if back:
        yield ended()


def _reports(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Segments with their states in order -> one row a conversation."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int64() if k < 7 else pa.string()) for k, c in enumerate(cols)], names=names)

    now: dict | None = None

    def end() -> None:
        cost, labels = end_weight(now["state"])
        for _, role, text in edited([], labels, now["state"]):
            say(role, text)
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
        done.append((now["conv"], gaps, *(now[c] for c in _STATS[:4]), now["cost"] + cost, "".join([*now["audit"], labels]), now["hash"].hexdigest()))

    def say(role: str, text: str) -> None:
        now["hash"].update(f"{'' if now['empty'] else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        now["empty"] = False

    for begins, r in _by_conversation(batches):
        if begins:
            if now:
                end()
            if len(done) >= 512:
                yield batch()
            now = {"conv": r["conv"], "hash": hashlib.sha256(), "empty": True, "audit": [], "cost": 0, "low": None, "high": None, **dict.fromkeys(_STATS, 0)}
        path = next(p for p in r["paths"] if (p["start"], p["end"]) == (r["start"], r["end"]))
        for label, role, text in edited(list(zip(r["roles"], r["texts"], strict=True)), path["labels"], r["start"]):
            if label != "D":
                say(role, text)
        for c in _STATS:
            now[c] += r[c]
        now["illegal"] += r["illegal_before"]
        now["turns"] += r["turns_before"]
        now["audit"].append(path["labels"])
        now["cost"] += path["cost"]
        now["state"] = r["end"]
        now["low"] = r["low"] if now["low"] is None else now["low"]
        now["high"] = r["high"] if r["high"] is not None else now["high"]
    if now:
        end()
    if done:
        yield batch()


def damaged(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with the faults that crc32 of ``conv:turn`` modulo 20 deals out: 0
    drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user. Nulls read
    as one space, but for conv and turn in their own columns."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    said = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    rows = convs.select(conv.alias("conv"), turn.cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), fate.alias("fate")).where("fate <> 0")
    return rows.select(
        "conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _segmented(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All segments with the states of their best paths (start, end) and counts for what is before them:
    those that are whole conversations, and the others."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["conv"]
    order = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    rows = rows.withColumn("digest", F.md5("text"))
    seen = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("earliest"))
    marked = rows.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    marked = marked.select("conv", "turn", "role", "text", (order > F.col("earliest")).alias("later"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(shards, "conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    segments = scratch.written(map_batches(dealt, _segments, f"conv {kind}, {_SEGMENT_SQL}"), "segments", keep=True)
    cut = segments.where("not whole")
    chained = cut.select("conv", "key", "first", "last", "low", "high", "paths").repartition("conv").sortWithinPartitions("conv", "key")
    states = scratch.written(chained.mapInArrow(_chain, "key long, start int, end int, illegal_before long, turns_before long"), "states", keep=True)
    best = F.array_min(F.transform(F.filter("paths", lambda p: p["start"] == 0), lambda p: F.struct(
        (p["cost"] + _by_state(p["end"], [end_weight(q)[0] for q in range(len(GRAMMAR))])).alias("cost"),
        F.concat(p["labels"], _by_state(p["end"], [end_weight(q)[1] for q in range(len(GRAMMAR))])).alias("labels"), p["end"].alias("end"))))
    zero = F.lit(0).cast("long")
    whole = segments.where("whole").select("*", F.lit(0).alias("start"), best["end"].alias("end"), zero.alias("illegal_before"), zero.alias("turns_before"))
    return whole, cut.join(states, "key")


def _by_state(state: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), state + 1)


def report(
    convs: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, over its rows by turn (nulls first; of one turn by role and text, in order of bytes).

    A row's first fault counts: blank (nothing but white space), duplicate (its role and text stand
    earlier), truncated (its last character that isn't white space is none of ``.!?``). gaps: turns missing
    between the least and greatest; illegal: neighbours whose role initials are not su, ua or au.
    cost and audit are those of the cheapest edits (K, R, D, I; ``row_weights``), of equal costs
    the least audit; repaired_sha256 is that of the repaired rows as ``role:text`` lines. With ``damage`` the rows are
    damaged first; a conversation that loses all its rows has zeros, no audit and the hash of nothing.

    Null roles and texts read as one space; a null conv_id is a conversation. Equal rows are duplicates;
    an empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(convs.sparkSession)
    kind = dict(convs.dtypes)[conv_col]
    if damage:
        rows = damaged(convs, conv_col, turn_col, role_col, text_col)
    else:
        conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
        rows = convs.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    whole, cut = _segmented(rows, scratch)
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            def again():
                yield first
                yield from batches
            yield from _reports(again(), first.schema.field("conv").type)

    columns = ["conv", "key", "roles", "texts", *_STATS, "low", "high", "paths", "start", "end", "illegal_before", "turns_before"]
    found = whole.select(*columns).mapInArrow(reports, schema).unionByName(
        cut.select(*columns).repartition("conv").sortWithinPartitions("conv", "key").mapInArrow(reports, schema)
    )
    found = scratch.written(found, "reports", keep=True)
    ids = convs.select(F.col(f"`{conv_col}`").alias("id")).distinct()
    none = {c: F.lit(0).cast("long") for c in ("gaps", *_STATS[:4], "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv")), "left").select(F.col("id").alias(conv_col), *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def repaired(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows: conv_col, place (in order, with gaps), edit (K, R or I), role, text. Nulls, ties
    and empty tables as in ``report``."""
    scratch = Scratch(convs.sparkSession)
    kind = dict(convs.dtypes)[conv_col]
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    rows = convs.select(conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    whole, cut = _segmented(rows, scratch)
    columns = ["conv", "key", "roles", "texts", "paths", "start", "end"]
    last = cut.groupBy("conv").agg(F.max("key").alias("end_key"))
    cut = cut.join(last.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).withColumn("ends", F.col("key") == F.col("end_key"))
    both = whole.withColumn("ends", F.lit(True)).select(*columns, "ends").unionByName(cut.select(*columns, "ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                labels = next(p["labels"] for p in r["paths"] if (p["start"], p["end"]) == (r["start"], r["end"]))
                rows = [*edited(list(zip(r["roles"], r["texts"], strict=True)), labels, r["start"])]
                if r["ends"]:
                    rows += edited([], end_weight(r["end"])[1], r["end"])
                out += [(r["conv"], (r["key"] << 13) + k, *e) for k, e in enumerate(rows) if e[0] != "D"]
            if out:
                types = [b.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv", "place", "edit", "role", "text"])

    return both.mapInArrow(run, f"conv {kind}, place long, edit string, role string, text string").withColumnRenamed("conv", conv_col)
