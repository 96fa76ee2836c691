"""Sensitive spans in text: shapes, labelled values, known values, and their removal.

Matches are arrays of structs in a column of the text's own row, so detection is one
projection without a shuffle; ``inline`` turns them to rows where rows are wanted. Patterns
go over whole Arrow batches (``functions.matching``); each looks for places only where a cheap test
finds what it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksum
from ..functions.dialect import JAVA_SPACE, java
from ..functions.matching import rule_matches
from ..functions.spans import find_all, fold_non_overlap, holds_any, let, replace_spans
from ..sources.stored import stored
from ..taxonomy import (
    CONTEXT_WINDOW,
    CREDENTIAL_STOP_WORDS,
    LABEL_WORDS,
    LABELLED_VALUES,
    LEAST_SEARCHABLE,
    PATTERN_RULES,
    SEPARATOR_INSENSITIVE,
    PatternRule,
)

_TYPED = "array<struct<start:int,end:int,pii_type:string,text:string>>"


def near_digits(text: Column) -> Column:
    """What a guard with ``by_digit`` may be tested on in place of the text: a long text's digits with 8 characters on
    either side, so that prose is gone through once and not once for each rule."""
    return F.when(F.length(text) > 160, F.regexp_replace(text, "([^0-9]{8})[^0-9]{2,}([^0-9]{8})", "$1\n$2")).otherwise(text)


def _valid(match: Column, rules: list[PatternRule]) -> Column:
    """Whether a match passes its rule's check."""
    out = F.lit(True)
    for name in dict.fromkeys(r.validator for r in rules if r.validator):
        own = [k for k, r in enumerate(rules) if r.validator == name]
        out = F.when(match["rule"].isin(own), checksum.VALIDATORS[name](match["text"])).otherwise(out)
    return out


def find_patterns(text: Column, context: Column | None = None, rules: list[PatternRule] = PATTERN_RULES) -> Column:
    """Matches of all rules: one that fails its check is used up all the same, one that overlaps a match of an earlier
    rule is dropped. By start."""
    # by rule, then start: matches of one rule are apart
    every = rule_matches(rules, CONTEXT_WINDOW)(text, near_digits(text), *([] if context is None else [context]))
    kept = let(F.filter(every, lambda m: _valid(m, rules)), fold_non_overlap)
    types, confidences = F.array(*[F.lit(r.pii_type) for r in rules]), F.array(*[F.lit(r.confidence) for r in rules])
    own = F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.get(types, m["rule"]).alias("pii_type"), F.get(confidences, m["rule"]).alias("confidence"), m["text"].alias("text"), m["rule"].alias("rule"),
    ))
    return F.when(text.isNotNull(), F.sort_array(own))


def labelled_matches(text: Column, rules=LABELLED_VALUES) -> Column:
    """Values after an explicit label: array of struct(start, end, pii_type, text), in order of rule."""

    def every(low: Column) -> Column:
        out = []
        for pii_type, pattern, checked in rules:
            found = find_all(text, java(pattern, True), 1, keep=(lambda v: checksum.looks_like_credential(v, CREDENTIAL_STOP_WORDS)) if checked else None)
            found, words = _typed(found, pii_type), LABEL_WORDS.get(pattern)
            out.append(F.when(holds_any(low, words), found).otherwise(F.array().cast(_TYPED)) if words else found)
        return F.concat(*out)

    return let(F.lower(text), every)


def _typed(found: Column, pii_type: str) -> Column:
    return F.transform(
        F.filter(found, lambda m: m["text"] != ""),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(pii_type).alias("pii_type"), m["text"].alias("text")),
    )


def escaped(value: Column) -> Column:
    """A value as a pattern of itself."""
    return F.regexp_replace(value, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def trimmed(value: Column) -> Column:
    """Without Unicode white space around it."""
    return F.regexp_replace(value, f"\\A[{JAVA_SPACE}]+|[{JAVA_SPACE}]+\\z", "")


#: What may be left out of a value whose separators are cosmetic, and what may stand between its characters.
_SEPARATORS, _BETWEEN = f"[{JAVA_SPACE}\\-/.()]", f"[{JAVA_SPACE}\\-/.]?"


def search_pattern(pii_type: Column, value: Column) -> Column:
    """How a known value is looked for: with optional separators between its characters
    for types whose separators are cosmetic, else as it is, with word boundaries where it begins or ends
    with an ASCII word character. Case never counts, in any script. Null for values too short to search for."""
    own = trimmed(value)
    bare = F.regexp_replace(own, _SEPARATORS, "")
    loose = F.array_join(F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), escaped), _BETWEEN)
    edge = java(r"\b")
    exact = F.concat(
        F.when(own.rlike(r"\A[A-Za-z0-9_]"), F.lit(edge)).otherwise(F.lit("")), escaped(own), F.when(own.rlike(r"[A-Za-z0-9_]\z"), F.lit(edge)).otherwise(F.lit(""))
    )
    rx = F.when(pii_type.isin(SEPARATOR_INSENSITIVE), F.when(bare != "", loose)).otherwise(exact)
    return F.when(F.length(own) >= LEAST_SEARCHABLE, F.concat(F.lit("(?iu)"), rx))


def search_length(pii_type: Column, value: Column) -> Column:
    """How long a value's pattern is as it is usually written: the order in which patterns are used."""
    own = trimmed(value)
    bare = F.filter(F.split(F.regexp_replace(own, _SEPARATORS, ""), ""), lambda c: c != "")
    loose = F.length(escaped(F.array_join(bare, ""))) + len(r"[\s\-/.]?") * (F.size(bare) - 1)
    edges = own.rlike(r"\A[A-Za-z0-9_]").cast("int") + own.rlike(r"[A-Za-z0-9_]\z").cast("int")
    return F.when(pii_type.isin(SEPARATOR_INSENSITIVE), loose).otherwise(F.length(escaped(own)) + len(r"\b") * edges)


#: Code points of a gram, grams that a value is tried with, and bytes of a table that may be broadcast.
GRAM, TRIED, BROADCAST_BYTES = 5, 8, 8 << 20


def small_side(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has no more than ``BROADCAST_BYTES``, measured as JSON."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def folded(s: Column) -> Column:
    """Alike for strings that differ in case alone, as patterns take it, in any script: a key, not a text."""
    return F.translate(F.replace(F.lower(F.upper(s)), F.lit("ß"), F.lit("ss")), "ς\u0307", "σ")


def grams(s: Column, size: int) -> Column:
    """The runs of ``size`` code points of a string, in order."""
    of = lambda c: F.when(F.size(c) >= size, F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda k: F.concat(*[F.get(c, k + n) for n in range(size)])))
    return F.coalesce(let(F.filter(F.split(s, ""), lambda c: c != ""), of), F.array().cast("array<string>"))


def known_candidates(texts: DataFrame, known: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """Rows (keys, pii_type, value, slot, rx): the values that a text may hold.

    A text that holds a value holds each of its grams, code points of any script with case folded
    (for values with cosmetic separators: those of the text without separators). Of up to ``TRIED`` grams of
    a value the one that the fewest texts have is its key; a value with a gram that no text has
    is in none. So the join meets few texts a value, and no common word makes a hot key of many values.
    """
    wanted = known.select("pii_type", "value", "slot", search_pattern(F.col("pii_type"), F.col("value")).alias("rx")).where("rx is not null").distinct()
    loose = F.col("pii_type").isin(SEPARATOR_INSENSITIVE)
    bare = lambda c: F.regexp_replace(c, _SEPARATORS, "")
    wanted = wanted.withColumn("loose", loose).withColumn("key", F.when(loose, bare(folded("value"))).otherwise(folded(trimmed(F.col("value")))))
    wanted = wanted.withColumn("size", F.least(F.lit(GRAM), F.length("key")))
    all_of = F.coalesce(*[F.when(F.col("size") == n, grams(F.col("key"), n)) for n in range(1, GRAM + 1)])
    spaced = lambda g: F.transform(F.sequence(F.lit(0), F.least(F.lit(TRIED), F.size(g)) - 1), lambda k: F.get(g, F.floor(k * F.size(g) / F.least(F.lit(TRIED), F.size(g))).cast("int")))
    tried = wanted.withColumn("gram", F.explode(F.array_distinct(let(all_of, spaced))))
    kinds = [(r["loose"], r["size"]) for r in wanted.select("loose", "size").distinct().collect()]  # two forms of up to GRAM sizes

    def having(wanted_grams: DataFrame) -> DataFrame:
        side, parts = small_side(wanted_grams), []
        for form in sorted({k for k, _ in kinds}):
            text = folded(F.col(text_col))
            own = F.flatten(F.array(*[grams(bare(text) if form else text, n) for k, n in kinds if k == form]))
            parts.append(texts.select(*keys, F.lit(form).alias("loose"), F.explode(F.array_distinct(own)).alias("gram")))
        if not parts:
            parts = [texts.select(*keys, F.lit(False).alias("loose"), F.lit("").alias("gram")).where(F.lit(False))]
        return reduce(DataFrame.unionByName, parts).join(side, ["loose", "gram"])

    # grams of texts are dear: those that are tried are found once, for the counts and for the pairs
    had = stored(having(tried.select("loose", "gram").distinct()), "grams")
    counts = had.groupBy("loose", "gram").agg(F.count("*").alias("n"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    chosen = tried.join(counts, ["loose", "gram"], "left").groupBy("pii_type", "value", "slot", "rx", "loose").agg(F.min(rarity).alias("key"))
    chosen = chosen.where("key.n > 0").select("loose", F.col("key.gram").alias("gram"), "pii_type", "value", "slot", "rx")
    return had.join(small_side(chosen), ["loose", "gram"]).select(*keys, "pii_type", "value", "slot", "rx")


def _possible(text_col: str) -> Column:
    """A cheap test before a value's pattern."""
    return F.col("pii_type").isin(SEPARATOR_INSENSITIVE) | F.contains(folded(F.col(text_col)), folded(trimmed(F.col("value"))))


def known_matches(texts: DataFrame, known: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """Rows (keys, start, end, pii_type, slot, text): known values (pii_type, value, slot) found
    in texts; of overlapping ones the longest stays, then the first."""
    tried = texts.join(known_candidates(texts, known, text_col, keys), keys)
    hits = F.when(_possible(text_col), find_all(F.col(text_col), F.col("rx")))
    rows = tried.select(*keys, "pii_type", "slot", hits.alias("hits")).where(F.size("hits") > 0).select(*keys, "pii_type", "slot", F.inline("hits"))
    ranked = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("longest"), "start", "end", "pii_type", "slot", "text")))
    return rows.groupBy(*keys).agg(fold_non_overlap(ranked).alias("m")).select(*keys, F.inline("m")).drop("longest")


def known_pairs(texts: DataFrame, known: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """Rows (keys, pii_type, slot): which values each text holds; no place of them is looked for."""
    tried = texts.join(known_candidates(texts, known, text_col, keys), keys)
    return tried.where(_possible(text_col) & F.regexp_like(F.col(text_col), F.col("rx"))).select(*keys, "pii_type", "slot").distinct()


def holding_known(texts: DataFrame, known: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """The keys of texts that hold any known value."""
    return known_pairs(texts, known, text_col, keys).select(*keys).distinct()


def swept(texts: DataFrame, known: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """``texts`` with spans: known values, then shapes, then labelled values, none overlapping
    (``sensitive_spans``)."""
    found = known_matches(texts, known, text_col, keys).groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "pii_type")).alias("__known"))
    return texts.join(found, keys, "left").withColumn("spans", sensitive_spans(F.col(text_col), F.col("__known"))).drop("__known")


URL = r"(?i)https?://[^\s\"'<>]+"


def sanitize_urls(text: Column) -> Column:
    """Each web address as its origin: no path, query, fragment or user; <HIDDEN_URL> if it has no host."""
    rx = java(r"https?://[^\s\"'<>]+", True)
    # an address reads nothing but what it takes
    found = find_all(text, rx, alone=True)

    def origin(url: Column) -> Column:
        scheme = F.lower(F.regexp_extract(url, r"(?i)\A(https?)://", 1))
        host = F.lower(F.regexp_extract(url, r"(?i)\Ahttps?://(?:[^/?#\\]*@)?([^/?#\\:@]+)", 1))
        port = F.regexp_extract(url, r"(?i)\Ahttps?://(?:[^/?#\\]*@)?[^/?#\\:@]+:([0-9]+)", 1)
        usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
        return F.when(host == "", F.lit("<HIDDEN_URL>")).otherwise(F.concat(scheme, F.lit("://"), host, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port))))

    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), origin(m["text"]).alias("replacement")))
    return F.when(text.rlike("(?i)https?://"), replace_spans(text, spans)).otherwise(text)


def sensitive_spans(text: Column, known: Column | None = None) -> Column:
    """Known values (array of struct(start, end, pii_type), may be null), shapes and labelled values
    together: in this order, then the longer span, then the first; none overlap. array of
    struct(start, end, pii_type, source)."""
    ranked = lambda m, source, rank: F.struct(
        F.lit(rank).alias("rank"), (m["start"] - m["end"]).alias("longest"), m["start"].alias("start"), m["end"].alias("end"), m["pii_type"].alias("pii_type"), F.lit(source).alias("source")
    )
    both = F.concat(F.transform(find_patterns(text), lambda m: ranked(m, "pattern", 1)), F.transform(labelled_matches(text), lambda m: ranked(m, "label", 2)))
    if known is not None:
        own = F.transform(known, lambda m: ranked(m, "known_value", 0))
        both = F.concat(F.coalesce(own, F.filter(both, lambda m: F.lit(False))), both)
    kept = let(let(both, lambda a: F.sort_array(a)), fold_non_overlap)
    return F.sort_array(F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["pii_type"].alias("pii_type"), m["source"].alias("source"))))


def sanitized(text: Column, spans: Column | None = None) -> Column:
    """The text with each sensitive span as <HIDDEN_TYPE>, then its addresses cut to origins."""
    own = sensitive_spans(text) if spans is None else spans
    hidden = F.transform(own, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("<HIDDEN_"), F.upper(m["pii_type"]), F.lit(">")).alias("replacement")))
    return let(let(hidden, lambda h: replace_spans(text, h)), sanitize_urls)
