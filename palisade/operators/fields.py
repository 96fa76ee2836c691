"""What a form field's markup says about its content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import JAVA_SPACE, java
from ..functions.spans import holds_any, let
from ..taxonomy import AUTOCOMPLETE, AUTOCOMPLETE_CONFIDENCE, INPUT_CONFIDENCE, INPUT_TYPES, LABEL_RULES, PASSWORD_INPUT_CONFIDENCE


def split_identifier(name: Column) -> Column:
    """A programmer's identifier as words: separators, camel case, acronyms, digits. Null if empty."""
    out = F.regexp_replace(name, r"[_\-.\[\]]+", " ")
    for rx in (r"([a-z0-9])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([A-Za-z])([0-9])"):
        out = F.regexp_replace(out, rx, "$1 $2")
    return F.when(F.coalesce(name, F.lit("")) != "", F.trim(out))


def _lookup(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), value)


def input_signal(input_type: Column) -> Column:
    kind = _lookup(F.lower(input_type), INPUT_TYPES)
    return F.when(kind.isNotNull(), F.struct(kind.alias("pii_type"), F.when(F.lower(input_type) == "password", PASSWORD_INPUT_CONFIDENCE).otherwise(INPUT_CONFIDENCE).alias("confidence"), F.lit("input").alias("evidence")))


def autocomplete_signal(autocomplete: Column) -> Column:
    """By the last token; sections and billing prefixes do not matter."""
    kind = _lookup(F.regexp_extract(F.trim(F.lower(autocomplete)), rf"([^{JAVA_SPACE}]+)\z", 1), AUTOCOMPLETE)
    return F.when(kind.isNotNull(), F.struct(kind.alias("pii_type"), F.lit(AUTOCOMPLETE_CONFIDENCE).alias("confidence"), F.lit("autocomplete").alias("evidence")))


def label_signal(name: Column, placeholder: Column, field_name: Column) -> Column:
    """The first label rule that the name, placeholder or identifier's words satisfy."""
    said = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(placeholder, F.lit("")), split_identifier(field_name))

    def first(s: Column) -> Column:
        found = F.lit(None).cast("struct<pii_type:string,confidence:double>")
        for r in reversed(LABEL_RULES):
            found = F.when(holds_any(s["low"], r.words) & s["said"].rlike(java(r.pattern, True)), F.struct(F.lit(r.pii_type).alias("pii_type"), F.lit(r.confidence).alias("confidence"))).otherwise(found)
        return found

    # what is said is put together once and the rules are gone through once
    return let(let(let(said, lambda x: F.struct(x.alias("said"), F.lower(x).alias("low"))), first), lambda found: F.when(found.isNotNull(), F.struct(found["pii_type"].alias("pii_type"), found["confidence"].alias("confidence"), F.lit("label").alias("evidence"))))


def signals(input_type: Column, autocomplete: Column, name: Column, placeholder: Column, field_name: Column) -> Column:
    """array<struct<pii_type,confidence,evidence>>: one of each kind at most."""
    return F.array_compact(F.array(input_signal(input_type), autocomplete_signal(autocomplete), label_signal(name, placeholder, field_name)))


def conflicting(declared: Column, matched: Column) -> Column:
    """Both sides say something and agree on nothing."""
    return (F.size(declared) > 0) & (F.size(matched) > 0) & (F.size(F.array_intersect(declared, matched)) == 0)
