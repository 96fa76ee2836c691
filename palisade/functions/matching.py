"""Matches of many fixed patterns, found in batches of texts.

A rule's cheap tests and its pattern's test go over a whole Arrow batch (RE2, linear in the text); places are looked
for only in the texts that they let through. What a match must satisfy beside is left to Column functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..taxonomy import PatternRule
from .dialect import python, re2

MATCH = "array<struct<rule:int,start:int,end:int,text:string>>"


def rule_matches(rules: list[PatternRule], window: int) -> Callable[..., Column]:
    """f(text, digits[, context]) -> array of struct(rule, start, end, text) by rule, then start: matches of each rule that have its
    context word within ``window`` characters, if it asks for one, in the text or at their place in ``context``. ``digits``: what
    tests with ``by_digit`` may read in the text's place."""
    searches = []
    for k, r in enumerate(rules):
        # RE2 has no lookbehind: such a guard is left to the pattern itself
        guard = r.guard if "(?<" not in r.guard else re2(r.pattern, r.ignore_case)
        words = "(?i)" + "|".join(map(re.escape, r.words)) if r.words else ""
        whole = "" if r.context else re2(r.pattern, r.ignore_case)
        near = python(r.context, True) if r.context else None
        searches.append((k, words, guard, r.by_digit, whole, re2(r.context, True) if r.context else "", near, python(r.pattern, r.ignore_case), r.validator == "portal_identifier"))

    # all of it is one nested function: executors need not import this package
    def found(texts: pa.Array, digits: pa.Array, *context: pa.Array) -> pa.Array:
        contexts = context[0] if context else None

        def strings(a: pa.Array) -> list:
            try:
                return a.to_pylist()
            except UnicodeDecodeError:
                return [None if v is None else v.decode("utf-8", "replace") for v in a.cast(pa.binary()).to_pylist()]

        def having(rx: str, own: pa.Array, other: pa.Array | None = None) -> pa.Array:
            hit = pc.fill_null(pc.match_substring_regex(own, rx), False)
            return hit if other is None else pc.or_(hit, pc.fill_null(pc.match_substring_regex(other, rx), False))

        rows, rule, start, end, said = [], [], [], [], []
        for k, words, guard, by_digit, whole, nearby, near, pattern, with_digit in searches:
            at = None
            for rx, own, other in ((guard, digits if by_digit else texts, None), (words, texts, contexts), (nearby, texts, contexts), (whole, texts, None)):
                if rx and (at is None or len(at)):
                    hit = having(rx, own if at is None else own.take(at), other if at is None or other is None else other.take(at))
                    at = pc.indices_nonzero(hit) if at is None else at.filter(hit)
            if at is None:
                at = pc.indices_nonzero(texts.is_valid())
            if not len(at):
                continue
            beside = strings(contexts.take(at)) if near and contexts is not None else None
            for j, (row, text) in enumerate(zip(at.to_pylist(), strings(texts.take(at)), strict=True)):
                for m in pattern.finditer(text):
                    value, a, b = m[0], m.start(), m.end()
                    if with_digit and not any("0" <= c <= "9" for c in value):
                        continue
                    if near:
                        first = max(a - window, 0)
                        if not near.search(text[first : b + window]) and not (beside and beside[j] and near.search(beside[j][first : b + window])):
                            continue
                    rows.append(row)
                    rule.append(k)
                    start.append(a)
                    end.append(b)
                    said.append(value)
        where = np.asarray(rows, np.int64)
        order = pa.array(np.argsort(where, kind="stable"))
        ends = np.zeros(len(texts) + 1, np.int32)
        np.cumsum(np.bincount(where, minlength=len(texts)), out=ends[1:])
        columns = [*(pa.array(v, pa.int32()).take(order) for v in (rule, start, end)), pa.array(said, pa.string()).take(order)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["rule", "start", "end", "text"]))

    return F.arrow_udf(found, MATCH)
