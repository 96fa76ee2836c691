"""Spans of a text: array<struct<start,end,text>>, half-open, in code points from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def holds_any(low: Column, words: tuple[str, ...]) -> Column:
    """A cheap test before a pattern that ignores the case of ASCII letters: some word in the lower-case text."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def find_all(text: Column, pattern: str | Column, group: int = 0, keep=None, alone: bool = False) -> Column:
    """All matches of a pattern that takes a character at least. ``group``: what is kept as text, with the start of its
    last occurrence in the match; the matches themselves decide where the next begins. ``keep``: a condition on what is kept;
    matches without it are used up all the same, but where they are is not looked for if it holds for none. ``alone``: the pattern
    reads nothing but what it takes (no boundary, nothing behind or ahead)."""
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def placed(parts: Column, hits: Column, values: Column, stays: Column | None) -> Column:
        def step(acc: Column, k: Column) -> Column:
            hit, value = F.get(hits, k), F.get(values, k)
            begin = acc["at"] + F.length(F.get(parts, k))
            # the value's last occurrence in the match, found in the reversed strings
            shift = F.length(hit) - F.length(value) - (F.instr(F.reverse(hit), F.reverse(value)) - 1) if group else F.lit(0)
            own = F.struct((begin + shift).alias("start"), (begin + shift + F.length(value)).alias("end"), value.alias("text"))
            out = F.array_append(acc["out"], own)
            return F.struct((begin + F.length(hit)).alias("at"), (out if stays is None else F.when(F.get(stays, k), out).otherwise(acc["out"])).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda acc: acc["out"])

    # what stands before each match: a pattern that splits would be compiled anew for each text
    before = F.concat(F.lit("(?s:(.*?))(?:"), rx, F.lit(r"|\z)"))

    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    parts = F.regexp_extract_all(text, before, F.lit(1))

    def all_of(hits: Column) -> Column:
        values = F.regexp_extract_all(text, rx, F.lit(group)) if group else hits
        if keep is None:
            return let(F.struct(parts.alias("parts"), values.alias("values")), lambda x: placed(x["parts"], hits, x["values"], None))
        checked = lambda v: F.struct(v.alias("values"), F.transform(v, lambda x: F.coalesce(keep(x), F.lit(False))).alias("stays"))
        return let(let(values, checked), lambda x: F.when(F.array_contains(x["stays"], True), let(parts, lambda p: placed(p, hits, x["values"], x["stays"]))).otherwise(none))

    if alone and not group and keep is None:
        # then the next match begins where its characters first stand: no second pattern is compiled for the row
        def next_one(acc: Column, hit: Column) -> Column:
            begin = F.call_function("locate", hit, text, acc["at"] + 1) - 1
            own = F.struct(begin.alias("start"), (begin + F.length(hit)).alias("end"), hit.alias("text"))
            return F.struct((begin + F.length(hit)).alias("at"), F.array_append(acc["out"], own).alias("out"))

        return F.aggregate(F.regexp_extract_all(text, rx, F.lit(0)), start, next_one, lambda acc: acc["out"])

    # a text without a match is read once
    return let(F.regexp_extract_all(text, rx, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, all_of(hits)).otherwise(none))


def fold_non_overlap(sorted_spans: Column) -> Column:
    """Keeps each span that overlaps none kept before it (fields start and end)."""
    empty = F.filter(sorted_spans, lambda s: F.lit(False))
    return F.aggregate(
        sorted_spans, empty,
        lambda kept, s: F.when(F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])), kept).otherwise(F.array_append(kept, s)),
    )


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with each span (fields start, end, replacement; ordered, apart) replaced."""
    done = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["replacement"]).alias("out")),
    )
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
