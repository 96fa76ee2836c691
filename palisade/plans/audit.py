"""The check of a page from its markup to what may leave: elements, detections, findings,
plan, allow-listed packet. Every step is keyed by page; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import detect_text, fields, packet, redact
from ..sources import pages
from ..sources.stored import stored
from ..taxonomy import POLICIES

#: The flow layout that stands in for geometry, and the viewport.
LEFT, STEP, WIDTH, HEIGHT, VIEW_W, VIEW_H = 8, 28, 180, 24, 1280, 800


def laid_out(html: DataFrame) -> DataFrame:
    """Elements with an id and a rectangle of a simple flow layout."""
    rows = pages.elements(html)
    return rows.withColumns({"element_id": F.concat(F.lit("el_"), F.col("n")), "rect": g.rect(F.lit(LEFT), F.col("n") * STEP, F.lit(WIDTH), F.lit(HEIGHT))})


def _policy(column: str, default) -> Column:
    table = F.create_map(*[F.lit(x) for p in POLICIES for x in (p.pii_type, getattr(p, column))])
    return F.coalesce(table[F.col("pii_type")], F.lit(default))


def detections(rows: DataFrame) -> DataFrame:
    """One row a detection: patterns over each text of an element, and what its markup declares."""
    texts = rows.select("page_id", "element_id", "rect", "n", F.concat_ws(" ", "name", "role", "own_text").alias("context"), F.stack(F.lit(3), F.lit("value"), "value", F.lit("text"), "own_text", F.lit("name"), "name").alias("field", "body"))
    texts = texts.where("body <> ''")
    hits = texts.select("page_id", "element_id", "rect", "n", "field", "body", F.inline(detect_text.find_patterns(F.col("body"), F.col("context"))))
    patterns = hits.select(
        "page_id", "element_id", "field", "pii_type", "confidence", "start", "end", F.lit("pattern").alias("detector"), F.col("text").alias("matched_text"), F.lit(None).cast("string").alias("slot"),
        F.when(F.col("field") == "name", F.col("rect")).otherwise(g.span_rect(F.col("rect"), F.col("body"), F.col("start"), F.col("end"))).alias("rect"), (F.col("n") * 10000 + F.col("start")).cast("long").alias("seq"),
    )
    a = lambda n: F.col("attrs")[n]
    declared = rows.where("editable").select("page_id", "element_id", "rect", "n", "value", F.inline(fields.signals(a("type"), a("autocomplete"), F.col("name"), a("placeholder"), a("name"))))
    null = lambda kind: F.lit(None).cast(kind)
    structural = declared.where("value <> ''").select(
        "page_id", "element_id", F.lit("value").alias("field"), "pii_type", F.col("confidence").cast("double").alias("confidence"), null("int").alias("start"), null("int").alias("end"),
        F.lit("structural").alias("detector"), F.col("value").alias("matched_text"), null("string").alias("slot"), "rect", (F.col("n") * 10000).cast("long").alias("seq"),
    )
    return patterns.unionByName(structural)


def found_in(rows: DataFrame) -> DataFrame:
    """Fused detections of elements at or above their type's threshold, with mode, paint and replacement."""
    found = redact.fused(detections(rows).withColumn("conflicting", F.lit(False)), ["page_id", "pii_type", "element_id", "field", "start", "end"])
    kept = found.where(F.col("confidence") >= _policy("threshold", 1.0)).withColumn("redaction", redact.resolve_mode(F.lit(None).cast("string"), _policy("redaction", "placeholder"), _policy("never_blur", True)))
    return redact.planned(kept, "page_id", g.rect(*map(F.lit, (0, 0, VIEW_W, VIEW_H))))


def findings(html: DataFrame) -> DataFrame:
    """``found_in`` the elements of pages."""
    return found_in(stored(laid_out(html), "elements"))


def titles(html: DataFrame) -> DataFrame:
    """(page_id, title) of each page, white space as one space."""
    said = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return html.select("page_id", F.trim(F.regexp_replace(said, r"\s+", " ")).alias("title"))


def packets(html: DataFrame, vault: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """(page_id, packet, bytes, n_nodes, n_findings, coverage, verdict, withheld): what may leave a
    page as JSON. Only named columns go in; texts are edited where something was found, swept of
    every literal known on the page, and withheld if one is left. vault: (page_id, seq, pii_type, value, slot).

    Elements and findings are written once: the sweep, the last check, areas and counts all read them."""
    rows = stored(laid_out(html), "elements")
    found = stored(found_in(rows), "findings")
    vault = found.sparkSession.createDataFrame([], "page_id long, seq long, pii_type string, value string, slot string") if vault is None else vault
    nodes = rows.select(
        "page_id", "element_id", "n", "role", "name", F.nullif("own_text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("array<string>").alias("options"),
        "hidden", "interactive", "editable", "disabled", "rect", (F.col("editable") & (F.trim("value") != "")).alias("filled"),
    )
    own, title, withheld, offers = packet.built(nodes, titles(html), found, vault, with_text)
    box = F.transform(F.array(*[F.col(f"rect.{c}") for c in ("x", "y", "width", "height")]), lambda v: F.floor(v + 0.5))
    flag = lambda c: F.when(F.col(c), True).alias(c)
    node = F.struct("n", F.col("element_id").alias("id"), "role", "name", box.alias("rect"), "interactive", "editable", flag("disabled"), flag("filled"), "text", flag("sensitive"), flag("suspect"))
    listed = own.groupBy("page_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.count("*").alias("n_nodes"))
    gone = withheld.groupBy("page_id").agg(F.count("*").alias("withheld"))
    paints = found.where("paint is not null").select("page_id", F.col("paint").alias("r"))
    areas = redact.union_areas(paints, "page_id")
    counts = found.groupBy("page_id").agg(F.count("*").alias("n_findings"))
    bottom = rows.groupBy("page_id").agg(F.max(g.bottom(F.col("rect"))).alias("bottom"))
    cover = redact.coverage(F.coalesce("area", F.lit(0.0)), F.lit(float(VIEW_W)), F.lit(float(VIEW_H)))
    out = html.select("page_id", "url")
    for part in (title, listed, areas, counts, gone, offers, bottom):
        out = out.join(part, "page_id", "left")
    out = out.withColumn("coverage", cover)
    low = F.coalesce("bottom", F.lit(0.0))
    body = F.to_json(F.struct(
        F.lit(1).alias("schema_version"), pages.origin(F.col("url")).alias("origin"), F.coalesce("title", F.lit("")).alias("title"), F.struct(F.lit(VIEW_W).alias("width"), F.lit(VIEW_H).alias("height")).alias("viewport"),
        F.struct(F.lit(0).alias("y"), F.floor(F.greatest(F.lit(float(VIEW_H)), low) + 0.5).alias("page_height"), (low > VIEW_H + 4).alias("more_below")).alias("scroll"),
        F.transform("nodes", lambda x: x.dropFields("n")).alias("nodes"), "placeholders", F.round("coverage", 4).alias("coverage"),
    ))
    none = F.lit(0).cast("long")
    return out.select("page_id", body.alias("packet"), F.octet_length(body).alias("bytes"), F.coalesce("n_nodes", none).alias("n_nodes"), F.coalesce("n_findings", none).alias("n_findings"),
                      "coverage", redact.verdict(F.col("coverage")).alias("verdict"), F.coalesce("withheld", none).alias("withheld"))
