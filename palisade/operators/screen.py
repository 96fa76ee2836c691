"""Detection over a whole screen: elements, recognised words, visual lines, and every other place of what was found.

Each channel is a projection over its own rows; all are one union, and detections of a type at a place are
one finding. Joins have the page as their key: a page's stored values, its confirmed literals and its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.spans import find_all, fold_non_overlap
from ..sources.stored import stored
from ..taxonomy import LEAST_SEARCHABLE, POLICIES
from . import detect_text, fields, redact, session, words

#: Where a detection was made, its evidence, and the rank of its channel in order of time.
DETECTION = (
    "page_id", "pii_type", "location", "element_id", "field", "start", "end", "detector", "confidence", "rect", "slot", "matched_text", "conflicting", "seq",
)
#: What decides whether two detections are one finding.
PLACE = ["page_id", "pii_type", "location", "field", "start", "end"]
_STEP = 1_000_000_000


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def at_rect(r: Column) -> Column:
    """The name of a place that belongs to no element."""
    half = lambda v: F.floor(v + 0.5).cast("string")
    return F.concat_ws(":", F.lit("ocr"), half(r["x"]), half(r["y"]), half(r["width"]), half(r["height"]))


def _detections(rows: DataFrame, **columns: Column) -> DataFrame:
    types = {"start": "int", "end": "int", "confidence": "double", "seq": "long", "conflicting": "boolean"}
    given = {"element_id": _null("string"), "field": _null("string"), "start": _null("int"), "end": _null("int"), "slot": _null("string"), "matched_text": _null("string"), "conflicting": F.lit(False)} | columns
    return rows.select(*[(given[c] if c in given else F.col(c)).cast(types[c]).alias(c) if c in types else (given[c] if c in given else F.col(c)).alias(c) for c in DETECTION])


def by_page(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the pages, and so go to executors by their keys: estimates of size, which start
    from compressed files, would have a side gathered on the driver for broadcast."""
    return left.join(right.hint("merge"), keys, how)


def known_in(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """``texts`` (page_id, tid, body ...) with a row (start, end, text, pii_type, slot) for each stored value of its page
    that it holds; of overlapping ones the longest, then the first."""
    rx = detect_text.search_pattern(F.col("pii_type"), F.col("value"))
    wanted = vault.select("page_id", F.col("seq").cast("long").alias("vseq"), "pii_type", "slot", rx.alias("rx")).where("rx is not null")
    pairs = by_page(texts.select("page_id", "tid", "body"), wanted, "page_id")
    hits = pairs.select("page_id", "tid", "pii_type", "slot", "vseq", F.inline(find_all(F.col("body"), F.col("rx")))).where("text <> ''")
    ranked = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("longest"), "start", "vseq", "end", "pii_type", "slot", "text")))
    kept = hits.groupBy("page_id", "tid").agg(fold_non_overlap(ranked).alias("m")).select("page_id", "tid", F.inline("m"))
    return by_page(texts, kept.drop("longest", "vseq"), ["page_id", "tid"])


def scannable(elements: DataFrame) -> DataFrame:
    """(page_id, tid, element_id, n, k, field, body, context, rect): the five texts of each element, in order."""
    names = ["value", "text", "name", "placeholder", "ocr"]
    column = {"ocr": "ocr_text"}
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("field"), F.col(column.get(f, f)).alias("body")) for k, f in enumerate(names)])
    context = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "placeholder", "field_name", "role", "text")])
    rows = elements.select("page_id", "element_id", "n", "rect", context.alias("context"), F.inline(parts)).where("body <> ''")
    return rows.withColumn("tid", F.concat_ws(".", "element_id", "field"))


def _place(r: str = "rect") -> Column:
    """A span of a rendered text, or the whole element where the text is drawn otherwise."""
    return F.when(F.col("field").isin("name", "placeholder"), F.col(r)).otherwise(g.span_rect(F.col(r), F.col("body"), F.col("start"), F.col("end")))


def in_elements(elements: DataFrame, texts: DataFrame, vault: DataFrame) -> DataFrame:
    """What markup declares, stored values, shapes, and what a detector of pictures calls an element."""
    own = elements.withColumn("signals", fields.signals(F.col("input_type"), F.col("autocomplete"), F.col("name"), F.col("placeholder"), F.col("field_name")))
    said = lambda label: F.transform(F.filter("signals", lambda x: (x["evidence"] == "label") == F.lit(label)), lambda x: x["pii_type"])
    base = F.col("n").cast("long") * 10_000
    declared = own.select("page_id", "element_id", "n", "rect", fields.conflicting(said(False), said(True)).alias("conflicting"), F.posexplode("signals").alias("p", "x"))
    structural = _detections(
        declared, location=F.col("element_id"), element_id=F.col("element_id"), pii_type=F.col("x.pii_type"), confidence=F.col("x.confidence"), detector=F.lit("structural"),
        conflicting=F.col("conflicting"), seq=base + F.col("p"),
    )
    order = base + 100 + F.col("k") * 1000
    place = {"location": F.col("element_id"), "element_id": F.col("element_id"), "field": F.col("field"), "start": F.col("start"), "end": F.col("end"), "rect": _place()}
    known = _detections(known_in(texts, vault), **place, confidence=F.lit(1.0), detector=F.lit("known_value"), slot=F.col("slot"), matched_text=F.col("text"), seq=order)
    shapes = texts.select("*", F.inline(detect_text.find_patterns(F.col("body"), F.col("context"))))
    pattern = _detections(shapes, **place, detector=F.lit("pattern"), matched_text=F.col("text"), seq=order + 1)
    seen = elements.withColumn("pii_type", session.by_content(F.lower("label"), session.LABEL_TYPES, None)).where("pii_type is not null")
    visual = _detections(seen, location=F.col("element_id"), element_id=F.col("element_id"), detector=F.lit("vision_face"), seq=base + 9000)
    return structural.unionByName(known).unionByName(pattern).unionByName(visual)


def read_texts(screen_words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (page_id, tid, body, read, rect, n) of words, and of lines: joined by spaces, and without if that differs."""
    rect = g.rect(*[F.col(c) for c in ("x", "y", "width", "height")])
    single = screen_words.select("page_id", F.concat(F.lit("w"), F.col("n")).alias("tid"), F.col("text").alias("body"), F.col("confidence").alias("read"), rect.alias("rect"), F.col("n").cast("long").alias("n"))
    lines = words.lines(screen_words).select("page_id", "line", F.col("confidence").alias("read"), rect.alias("rect"), F.posexplode(F.array_distinct(F.array("text", "compact"))).alias("v", "body"))
    lines = lines.select("page_id", F.concat(F.lit("l"), F.col("line"), F.lit("."), F.col("v")).alias("tid"), "body", "read", "rect", (F.col("line").cast("long") * 2 + F.col("v")).alias("n"))
    return single.where("body <> ''"), lines.where("body <> ''")


def in_words(single: DataFrame, lines: DataFrame, vault: DataFrame) -> DataFrame:
    """Stored values and shapes in single words, each at its own box, and in lines, whose whole box they take: a shape
    counts as much as the reading is sure, but half at least."""
    sure = F.greatest(F.lit(0.5), F.col("read"))
    word = {"location": at_rect(F.col("rect")), "matched_text": F.col("text")}
    line = word | {"field": F.lit("ocr"), "start": F.col("start"), "end": F.col("end")}
    out = _detections(known_in(single, vault), **word, confidence=F.lit(1.0), detector=F.lit("known_value"), slot=F.col("slot"), seq=_STEP + F.col("n") * 2)
    shapes = lambda texts: texts.select("*", F.inline(detect_text.find_patterns(F.col("body"))))
    share = words.discounted(F.col("confidence"), F.col("read"))
    out = out.unionByName(_detections(shapes(single), **word, confidence=share, detector=F.lit("pattern"), seq=_STEP + F.col("n") * 2 + 1))
    out = out.unionByName(_detections(known_in(lines, vault), **line, confidence=sure, detector=F.lit("known_value"), slot=F.col("slot"), seq=2 * _STEP + F.col("n") * 2))
    return out.unionByName(_detections(shapes(lines), **line, confidence=share, detector=F.lit("pattern"), seq=2 * _STEP + F.col("n") * 2 + 1))


def everywhere(found: DataFrame, texts: DataFrame, single: DataFrame) -> DataFrame:
    """Detections of each literal that any channel has confirmed (by its strongest evidence, with its slot if it has one)
    in all other texts of its page, and in its words."""
    literal = detect_text.trimmed(F.col("matched_text"))
    sure = redact.fused(found, PLACE)
    confirmed = sure.where(F.length(literal) >= LEAST_SEARCHABLE).groupBy("page_id", "pii_type", F.lower(literal).alias("key")).agg(
        F.max("confidence").alias("confidence"), F.min_by("slot", F.when(F.col("slot").isNotNull(), F.col("seq"))).alias("slot"), F.max_by("matched_text", "seq").alias("value"), F.min("seq").alias("first")
    )
    wanted = confirmed.select("page_id", "pii_type", "confidence", "slot", "first", detect_text.search_pattern(F.col("pii_type"), F.col("value")).alias("rx")).where("rx is not null")
    by = F.when(F.col("slot").isNull(), "pattern").otherwise("known_value")
    pairs = by_page(texts, wanted, "page_id")
    hits = pairs.select("*", F.inline(find_all(F.col("body"), F.col("rx")))).where("text <> ''")
    place = {"location": F.col("element_id"), "element_id": F.col("element_id"), "field": F.col("field"), "start": F.col("start"), "end": F.col("end"), "rect": _place()}
    others = _detections(hits, **place, detector=by, slot=F.col("slot"), matched_text=F.col("text"), seq=3 * _STEP + F.col("first"))
    there = found.where("element_id is not null and start is not null").select(*PLACE).distinct()
    others = by_page(others, there, PLACE, "left_anti")
    # of two literals that are found at one place the first counts
    once = others.groupBy(*PLACE).agg(F.min_by(F.struct(*[c for c in DETECTION if c not in PLACE]), "seq").alias("d")).select(*PLACE, "d.*").select(*DETECTION)
    read = by_page(single, wanted.withColumnRenamed("confidence", "found"), "page_id").where(F.regexp_like("body", "rx"))
    again = _detections(read, location=at_rect(F.col("rect")), confidence=words.discounted(F.col("found"), F.col("read")), detector=by, slot=F.col("slot"), matched_text=F.col("body"), seq=3 * _STEP + F.col("first"))
    return once.unionByName(again)


def detections(elements: DataFrame, screen_words: DataFrame, vault: DataFrame) -> DataFrame:
    """All detections of pages, one row each (``DETECTION``).

    elements: (page_id, element_id, n, rect, role, name, text, value, placeholder, field_name, input_type, autocomplete,
    label, ocr_text, confidence); words: (page_id, n, text, x, y, width, height, confidence) that belong to no
    element; vault: (page_id, seq, pii_type, value, slot)."""
    texts = scannable(elements)
    single, lines = read_texts(screen_words)
    # lines are put together in Python and read three times
    lines = stored(lines, "lines")
    # evidence of all channels is read twice: as it is, and for what it confirms
    found = stored(in_elements(elements, texts, vault).unionByName(in_words(single, lines, vault)), "detections")
    return found.unionByName(everywhere(found, texts, single))


def _policy(column: str, default) -> Column:
    return F.coalesce(session.named(F.col("pii_type"), {p.pii_type: getattr(p, column) for p in POLICIES}, F.lit(None)), F.lit(default))


def findings(found: DataFrame) -> DataFrame:
    """Detections of one type at one place as one finding, if it is sure enough for its type's policy; the surest
    of a page first (rank from 1)."""
    out = redact.fused(found, [*PLACE, "element_id"])
    out = out.where(F.col("confidence") >= _policy("threshold", 1.0))
    out = out.withColumn("redaction", redact.resolve_mode(F.lit(None).cast("string"), _policy("redaction", "placeholder"), _policy("never_blur", True)))
    return redact.ranked(out, "page_id")


def stats(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(page_id, kind, name, n): detections by detector, findings by type, places below their threshold, and
    elements whose declarations disagree."""
    by_detector = found.groupBy("page_id", F.lit("detector").alias("kind"), F.col("detector").alias("name")).agg(F.count("*").alias("n"))
    by_type = kept.groupBy("page_id", F.lit("type").alias("kind"), F.col("pii_type").alias("name")).agg(F.count("*").alias("n"))
    conflicts = found.where("conflicting").groupBy("page_id").agg(F.count_distinct("element_id").alias("n")).select("page_id", F.lit("conflicts").alias("kind"), F.lit("").alias("name"), "n")
    return by_detector.unionByName(by_type).unionByName(_below(found, kept)).unionByName(conflicts)


def _below(found: DataFrame, kept: DataFrame) -> DataFrame:
    places = found.groupBy("page_id").agg(F.count_distinct(F.struct(*PLACE)).alias("all"))
    stay = kept.groupBy("page_id").agg(F.count("*").alias("stay"))
    n = F.col("all") - F.coalesce("stay", F.lit(0))
    return by_page(places, stay, "page_id", "left").select("page_id", F.lit("below").alias("kind"), F.lit("").alias("name"), n.alias("n")).where("n > 0")
