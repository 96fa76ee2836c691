"""What may leave a page: span edits, the sweep of known literals, a last check of every
content field, and what is withheld.

Everything is keyed by page: literals, tokens and fields of one page meet in joins on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let, replace_spans
from ..taxonomy import LEAST_SEARCHABLE, POLICIES
from . import redact, session
from .detect_text import search_pattern

#: Content fields of an element in the order in which they are checked; all other strings are the packet's own words.
FIELDS = ["name", "text", "problem", "options"]
_EPHEMERAL = [p.pii_type for p in POLICIES if p.lifetime == "ephemeral"]


def slot_token(pii_type: Column, slot: Column) -> Column:
    return F.upper(F.concat_ws("_", pii_type, slot))


def page_substitutions(findings: DataFrame, vault: DataFrame) -> DataFrame:
    """(page_id, substitutions): edits of the plan, then findings that it gave no edit, then stored values.

    findings: (page_id, seq, pii_type, matched_text, slot, replacement); vault: (page_id, seq, pii_type, value, slot)."""
    rows = lambda df, source, literal, token: df.select(F.col("page_id").alias("grp"), F.lit(source).alias("source"), F.col("seq").cast("long").alias("seq"), "pii_type", F.col(literal).alias("literal"), token.alias("token"))
    some = findings.where("matched_text is not null")
    known = (
        rows(some.where("replacement is not null"), 0, "matched_text", F.col("replacement"))
        .unionByName(rows(some, 1, "matched_text", redact.placeholder(F.col("pii_type"), F.col("slot"), F.lit(0))))
        .unionByName(rows(vault, 2, "value", slot_token(F.col("pii_type"), F.col("slot"))))
    )
    return session.substitutions(known).withColumnRenamed("grp", "page_id")


def edited(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """``nodes`` (page_id, element_id, name, text ...) with each span of a finding replaced in the field that it was
    measured in, and flags sensitive and suspect."""
    spans = findings.where("start is not null and replacement is not null and field in ('name', 'text')").groupBy("page_id", "element_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("start", "end", "replacement")))).alias(f"__{f}") for f in ("name", "text")]
    )
    flags = findings.where("element_id is not null").groupBy("page_id", "element_id").agg(F.lit(True).alias("sensitive"), F.bool_or("conflicting").alias("suspect"))
    out = nodes.join(spans, ["page_id", "element_id"], "left").join(flags, ["page_id", "element_id"], "left")
    said = lambda f: F.when(F.size(f"__{f}") > 0, let(F.col(f"__{f}"), lambda e: replace_spans(F.col(f), e))).otherwise(F.col(f))
    return out.withColumns({"name": said("name"), "text": said("text"), "sensitive": F.coalesce("sensitive", F.lit(False)), "suspect": F.coalesce("suspect", F.lit(False))}).drop("__name", "__text")


def swept(nodes: DataFrame, subs: DataFrame) -> DataFrame:
    """All content fields of ``nodes`` after the page's substitutions, one after the other."""
    own = nodes.join(subs, "page_id", "left")
    none = F.col("substitutions").isNull()
    clean = lambda c: F.when(none | c.isNull(), c).otherwise(session.scrubbed(c, F.col("substitutions")))
    return own.withColumns({
        "name": clean(F.col("name")), "text": clean(F.col("text")), "problem": clean(F.col("problem")),
        "options": F.transform("options", clean),
    }).drop("substitutions")


def content_fields(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """(page_id, place, path, text): every string that the page wrote, in the order in which it is checked."""
    path = lambda f: F.concat(F.lit("nodes["), F.col("element_id"), F.lit(f"].{f}"))
    parts = [F.struct(F.lit(k).alias("k"), path(f).alias("path"), (F.array_join("options", " ") if f == "options" else F.col(f)).alias("text")) for k, f in enumerate(FIELDS)]
    rows = nodes.select("page_id", "n", F.inline(F.array(*parts)))
    rows = rows.select("page_id", (F.col("n").cast("long") * len(FIELDS) + F.col("k") + 1).alias("place"), "path", "text")
    return rows.unionByName(titles.select("page_id", F.lit(0).cast("long").alias("place"), F.lit("packet.title").alias("path"), F.col("title").alias("text"))).where("text <> ''")


def survivors(fields: DataFrame, findings: DataFrame, vault: DataFrame) -> DataFrame:
    """(page_id, path, pii_type): content fields that hold a stored value, however it is separated, or a found
    literal as it is; the first stored value, then the first finding (the surest first), names the type."""
    stored = vault.select("page_id", F.struct(F.lit(0).alias("source"), F.lit(0.0).alias("rank"), F.col("seq").cast("long").alias("seq")).alias("at"), "pii_type", search_pattern(F.col("pii_type"), F.col("value")).alias("rx")).where("rx is not null")
    found = findings.where(F.length("matched_text") >= LEAST_SEARCHABLE)
    found = found.select("page_id", F.struct(F.lit(1).alias("source"), (-F.col("confidence")).cast("double").alias("rank"), F.col("seq").cast("long").alias("seq")).alias("at"), "pii_type", F.col("matched_text").alias("literal"))
    hits = fields.join(stored, "page_id").where(F.regexp_like("text", "rx")).select("page_id", "path", "at", "pii_type")
    hits = hits.unionByName(fields.join(found, "page_id").where(F.contains("text", "literal")).select("page_id", "path", "at", "pii_type"))
    return hits.groupBy("page_id", "path").agg(F.min_by("pii_type", "at").alias("pii_type"))


def without(nodes: DataFrame, withheld: DataFrame) -> DataFrame:
    """``nodes`` with withheld fields emptied: a name is '', others are not there."""
    gone = withheld.groupBy("page_id").agg(F.collect_set("path").alias("gone"))
    own = nodes.join(gone, "page_id", "left")
    drops = lambda f: F.coalesce(F.array_contains("gone", F.concat(F.lit("nodes["), F.col("element_id"), F.lit(f"].{f}"))), F.lit(False))
    return own.withColumns({f: F.when(~drops(f), F.col(f)).otherwise(F.lit("") if f == "name" else F.lit(None)) for f in FIELDS}).drop("gone")


def catalogue(findings: DataFrame, vault: DataFrame, subs: DataFrame) -> DataFrame:
    """(page_id, placeholders): tokens that a page offers, swept like any other string, each once: of findings
    with a slot, then of stored values that last; array of (token, pii_type, length, available)."""
    ephemeral = F.col("pii_type").isin(_EPHEMERAL)
    rows = findings.where("slot is not null and replacement <> '' and redaction not in ('drop', 'none')").select(
        "page_id", F.lit(0).alias("source"), F.col("seq").cast("long").alias("seq"), F.col("replacement").alias("token"), "pii_type", F.length(F.coalesce("matched_text", "replacement")).alias("length"), (~ephemeral).alias("available")
    ).unionByName(vault.where(~ephemeral).select(
        "page_id", F.lit(1).alias("source"), F.col("seq").cast("long").alias("seq"), slot_token(F.col("pii_type"), F.col("slot")).alias("token"), "pii_type", F.length("value").alias("length"), F.lit(True).alias("available")))
    safe = F.when(F.col("substitutions").isNull(), F.col("token")).otherwise(session.scrubbed(F.col("token"), F.col("substitutions")))
    rows = rows.join(subs, "page_id", "left").withColumn("token", safe)
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "token").orderBy("source", "seq"))).where("nth = 1")
    held = F.array_sort(F.collect_list(F.struct("source", "seq", "token", "pii_type", "length", "available")))
    return first.groupBy("page_id").agg(F.transform(held, lambda x: F.struct(*[x[c].alias(c) for c in ("token", "pii_type", "length", "available")])).alias("placeholders"))


def built(nodes: DataFrame, titles: DataFrame, findings: DataFrame, vault: DataFrame, with_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, titles, withheld, catalogue) of what may leave: allow-listed nodes that have something to say or to
    do, edited, swept and checked.

    nodes: (page_id, element_id, n, role, name, text, problem, options, hidden, interactive, editable ...);
    titles: (page_id, title); findings: (page_id, seq, element_id, field, start, end, pii_type, confidence, redaction,
    slot, matched_text, replacement, conflicting); vault: (page_id, seq, pii_type, value, slot). Without
    text only the names of controls and their options stay."""
    subs = page_substitutions(findings, vault)
    shown = nodes.where(~F.col("hidden") & (F.col("interactive") | F.col("text").isNotNull() | (F.col("name") != "")))
    own = swept(edited(shown, findings), subs)
    title = swept_title(titles, subs)
    if not with_text:
        null = F.lit(None).cast("string")
        own = own.withColumns({"text": null, "problem": null, "name": F.when(F.col("interactive") | F.col("editable"), F.col("name")).otherwise("")})
        title = title.withColumn("title", F.lit(""))
    withheld = survivors(content_fields(own, title), findings, vault)
    bad = withheld.where("path = 'packet.title'").select("page_id", F.lit(True).alias("bad"))
    title = title.join(bad, "page_id", "left").select("page_id", F.when(F.col("bad"), "").otherwise(F.col("title")).alias("title"))
    return without(own, withheld), title, withheld, catalogue(findings, vault, subs)


def swept_title(titles: DataFrame, subs: DataFrame) -> DataFrame:
    own = titles.join(subs, "page_id", "left")
    return own.select("page_id", F.when(F.col("substitutions").isNull(), F.col("title")).otherwise(session.scrubbed(F.col("title"), F.col("substitutions"))).alias("title"))

