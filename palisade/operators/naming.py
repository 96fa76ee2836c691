"""Names, descriptions, complaints and choices of elements, in what a reader of the screen hears.

All of it is joins over the element table of ``sources.tree``: references are lists of ids, exploded with
their places and put together again in order; labels, captions, options and forms are ranges that hold
an element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import pages
from ..sources.stored import stored
from ..sources.tree import inside, trees

# References of an element; most options and characters of one; the complaint of a browser.
NAMING, ERROR, DESCRIPTION = "aria-labelledby", "aria-errormessage", "aria-describedby"
MAX_OPTIONS, OPTION_CHARS = 40, 80
REFUSED = "the value is not accepted"
# Attributes that are read aloud.
SHOWN = ["aria-label", "placeholder", "value", "alt", "title"]
# Controls, those that carry their own caption, inputs that take no text, and what holds its caption as a child.
CONTROLS = ["input", "textarea", "select"]
CAPTIONED = {"submit": "Submit", "reset": "Reset", "button": ""}
NO_TEXT = ["button", "submit", "reset", "image", "checkbox", "radio", "file", "hidden"]
CAPTION_OF = {"fieldset": "legend", "table": "caption", "figure": "figcaption"}
DISABLEABLE = ["button", "fieldset", "input", "optgroup", "option", "select", "textarea"]
# White space, and the shape of an address of mail.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
EMAIL = r"\A[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\z"

KEY = ["page_id", "ord"]


def flat(text: Column, most: int = pages.NAME_CAP) -> Column:
    """White space to one blank, trimmed, cut; null for nothing."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(text, SPACE, " ")), 1, most), F.lit(""))


def _attr(name: str) -> Column:
    return F.nullif(F.col("attrs")[name], F.lit(""))


def _shown(name: str) -> Column:
    return F.col("shown")[name]


def read_trees(html: DataFrame) -> DataFrame:
    """``trees`` with the role, the words of an element's own and its attributes that are read aloud (SHOWN), flattened."""
    shown = F.transform_values(F.map_filter("attrs", lambda k, _: k.isin(SHOWN)), lambda _, v: flat(v))
    return trees(html).where("tag <> 'html'").withColumns({"role": pages.role(), "shown": shown, "text": flat(F.col("own_text"), pages.TEXT_CAP)})


def _has(name: str) -> Column:
    return F.map_contains_key("attrs", F.lit(name))


def _is(name: str, value: str) -> Column:
    return F.coalesce(F.col("attrs")[name] == value, F.lit(False))


def input_type() -> Column:
    return F.when(F.col("tag") == "input", F.lower(F.coalesce(F.col("attrs")["type"], F.lit("text"))))


def _put_together(pairs: DataFrame, rows: DataFrame, heard: bool) -> DataFrame:
    pieces = rows.where(F.size("pieces") > 0).select("page_id", F.col("ord").alias("at"), F.inline("pieces"))
    found = pairs.join(pieces, ["page_id", "at"]).where(F.col("veil") <= F.col("ord") if heard else F.col("said"))
    found = found.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "block", "body"))).alias("ps"))
    # two neighbours with another innermost block have the border of a block between them
    edge = "if(i > 0 and p.block <> ps[i - 1].block, ' ', '')" if heard else "''"
    return found.select(*KEY, F.expr(f"array_join(transform(ps, (p, i) -> concat({edge}, p.body)), '')").alias("body"))


def heard_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, ord, body): text below each of ``wanted`` (page_id, ord) without what is hidden from
    readers, 12 levels deep, blocks apart, with captions of images and buttons."""
    pairs = rows.where(F.size("pieces") > 0).select("page_id", F.col("ord").alias("at"), F.explode("up").alias("ord")).join(wanted.select(*KEY), KEY)
    return _put_together(pairs, rows, True)


def whole_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, ord, body): all text below each of ``wanted`` (page_id, ord, last), as it stands."""
    points = rows.where(F.size("pieces") > 0).select("page_id", F.col("ord").alias("at"))
    return _put_together(inside(points, wanted).select("page_id", "at", "ord"), rows, False)


def _in_order(rows: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*place, "body")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["body"]), " ").alias("body"))


def references(rows: DataFrame) -> DataFrame:
    """(page_id, ord, attribute, place, target, last, label): what the lists of ids point at, in their order;
    an id stands for the first element that has it, an id without one for nothing."""
    ids = rows.where(_attr("id").isNotNull()).groupBy("page_id", _attr("id").alias("id")).agg(F.min_by(F.struct(F.col("ord").alias("target"), "last", _shown("aria-label").alias("label")), "ord").alias("t"))
    lists = F.array(*[F.struct(F.lit(a).alias("attribute"), flat(F.col("attrs")[a], 1 << 30).alias("list")) for a in (NAMING, ERROR, DESCRIPTION)])
    own = rows.where(F.size(F.map_filter("attrs", lambda k, _: k.isin(NAMING, ERROR, DESCRIPTION))) > 0).select(*KEY, F.inline(lists)).where("list is not null")
    return own.select(*KEY, "attribute", F.posexplode(F.split("list", " ")).alias("place", "id")).join(ids, ["page_id", "id"]).select(*KEY, "attribute", "place", "t.*")


def facts(rows: DataFrame) -> DataFrame:
    """(page_id, ord, by_reference, heard_description, error, description, label, caption, content):
    what other elements of the page, and those below it, say of an element; flattened, null for nothing."""
    refs = stored(references(rows), "references")
    target = refs.select("page_id", F.col("target").alias("ord"), "last").distinct()
    wanted = rows.where(F.col("role").isin(pages.NAME_FROM_CONTENT) | F.col("tag").isin("label", *CAPTION_OF.values())).select("page_id", "ord", "last")
    heard = stored(heard_text(rows, wanted.union(target).distinct()), "heard")
    whole = whole_text(rows, target)
    text_of = lambda t: t.withColumnRenamed("ord", "target")

    named = refs.where(F.col("attribute") != ERROR).join(text_of(heard), ["page_id", "target"], "left").withColumn("body", F.coalesce(F.col("label"), "body"))
    said = refs.where(F.col("attribute") != NAMING).join(text_of(whole), ["page_id", "target"]).withColumn("body", flat(F.col("body"), 1 << 30))
    parts = [
        _in_order(named, [*KEY, "attribute"], ["place"]).withColumn("kind", F.when(F.col("attribute") == NAMING, "by_reference").otherwise("heard_description")).drop("attribute"),
        _in_order(said.where("body is not null"), [*KEY, "attribute"], ["place"]).withColumn("kind", F.when(F.col("attribute") == ERROR, "error").otherwise("description")).drop("attribute"),
    ]
    control = rows.where(F.col("tag").isin(CONTROLS))
    label = rows.where("tag = 'label'").select("page_id", "ord", "last", _attr("for").alias("id")).join(heard, KEY)
    by_id = control.select("page_id", "ord", _attr("id").alias("id")).join(label.where("id is not null").select("page_id", "id", F.lit(0).alias("way"), F.col("ord").alias("place"), "body"), ["page_id", "id"])
    around = inside(control.select("page_id", F.col("ord").alias("at")), rows.where("tag = 'label'").select("page_id", "ord", "last")).groupBy("page_id", "at").agg(F.max("ord").alias("ord"))
    around = around.join(label.select(*KEY, "body"), KEY).select("page_id", F.col("at").alias("ord"), F.lit(1).alias("way"), F.col("ord").alias("place"), "body")
    parts.append(_in_order(by_id.drop("id").unionByName(around), KEY, ["way", "place"]).withColumn("kind", F.lit("label")))

    holder = rows.where(F.col("tag").isin(list(CAPTION_OF))).select("page_id", F.col("tag").alias("holder"), "ord", "last")
    caption = rows.where(F.col("tag").isin(list(CAPTION_OF.values()))).select("page_id", F.col("tag").alias("caption"), F.col("ord").alias("at"))
    held = inside(caption, holder).join(holder.drop("last"), KEY).join(caption, ["page_id", "at"]).where(F.col("caption") == F.element_at(pages._map(CAPTION_OF), F.col("holder")))
    first = held.groupBy(*KEY).agg(F.min("at").alias("target"))
    parts.append(first.join(text_of(heard), ["page_id", "target"]).select(*KEY, "body", F.lit("caption").alias("kind")))
    parts.append(heard.select(*KEY, "body", F.lit("content").alias("kind")))

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    kinds = ["by_reference", "heard_description", "error", "description", "label", "caption", "content"]
    every = every.withColumn("body", F.when(F.col("kind").isin("error", "description"), flat(F.col("body"), pages.TEXT_CAP)).otherwise(flat(F.col("body"))))
    return every.groupBy(*KEY).agg(*[F.max(F.when(F.col("kind") == k, F.col("body"))).alias(k) for k in kinds])


def name() -> Column:
    """The first that says something: reference, own label, the tag's way, content, title."""
    kind, captioned = input_type(), list(CAPTIONED)
    control = F.coalesce("label", _shown("placeholder"))
    native = (
        F.when(kind.isin(captioned), F.coalesce(_shown("value"), F.nullif(F.element_at(pages._map(CAPTIONED), kind), F.lit(""))))
        .when(kind == "image", F.coalesce(_shown("alt"), F.lit("Submit"))).when(F.col("tag").isin(CONTROLS), control)
        .when(F.col("tag").isin("img", "area"), _shown("alt")).otherwise(F.col("caption"))
    )
    content = F.when(F.col("role").isin(pages.NAME_FROM_CONTENT), F.col("content"))
    return F.coalesce("by_reference", _shown("aria-label"), native, content, _shown("title"), F.lit(""))


def _refused() -> Column:
    """A browser's own judgement of the value in the markup: addresses and numbers. Patterns that a page
    brings are not run, as they are code of a stranger."""
    value, kind = _attr("value"), input_type()
    number = lambda n: F.col("attrs")[n].try_cast("double")
    bounds = F.coalesce(number("value") < number("min"), F.lit(False)) | F.coalesce(number("value") > number("max"), F.lit(False))
    wrong = F.when(kind == "email", ~value.rlike(EMAIL)).when(kind == "url", ~value.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:\S")).when(kind.isin("number", "range"), bounds)
    return F.coalesce(wrong, F.lit(False)) & value.isNotNull()


def choices(rows: DataFrame) -> DataFrame:
    """(page_id, ord, options, chosen): of each select the texts of its options and of the one that holds."""
    option = rows.where("tag = 'option'").select("page_id", "ord", "last", _has("selected").alias("selected"), (_has("disabled") | F.col("barred")).alias("off"), F.col("attrs")["label"].alias("own"))
    option = option.join(whole_text(rows, option), KEY, "left").withColumnRenamed("ord", "at")
    owner = rows.where("tag = 'select'").select("page_id", "ord", "last", _has("multiple").alias("many"), F.coalesce(F.col("attrs")["size"].try_cast("int"), F.lit(1)).alias("rows"))
    held = inside(option.select("page_id", "at"), owner).join(option.drop("last"), ["page_id", "at"]).join(owner.drop("last"), KEY)
    text = flat(F.coalesce(F.col("own"), F.col("body"), F.lit("")), OPTION_CHARS)
    one = F.when(F.col("selected"), F.when(F.col("many"), -F.col("at")).otherwise(F.col("at"))).when(~F.col("many") & (F.col("rows") <= 1) & ~F.col("off"), -(1 << 30) - F.col("at"))
    listed = F.slice(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("at", text.alias("o"))))), lambda x: x["o"]), 1, MAX_OPTIONS)
    return held.groupBy(*KEY).agg(F.nullif(listed, F.array().cast("array<string>")).alias("options"), F.max_by(F.coalesce("body", F.lit("")), one).alias("chosen"))


def elements(html: DataFrame) -> DataFrame:
    """The elements of ``html`` (page_id, html) that are worth a row, at most NODE_CAP a page in order:
    (page_id, n, ord, parent, tag, role, name, text, description, value, input_type, field_name, placeholder,
    autocomplete, interactive, focusable, editable, disabled, hidden, paints, required, invalid, message, options, form_id).

    ``parent`` is the n of the nearest element above that has a row. ``form_id`` counts forms from 1 by their
    first control; editable elements outside of all forms have 0, other elements null. Equal pages
    give equal rows; page_id must be unique.
    """
    rows = stored(read_trees(html), "tree")
    rows_with = rows.drop("pieces", "up").join(facts(rows), KEY, "left").join(choices(rows), KEY, "left")
    kind, tag = input_type(), F.col("tag")
    disabled = _is("aria-disabled", "true") | (tag.isin(DISABLEABLE) & (_has("disabled") | F.col("barred")))
    editing = F.coalesce(F.col("attrs")["contenteditable"].isin("true", ""), F.lit(False))
    editable = F.when(tag == "textarea", True).when(tag == "input", ~kind.isin(NO_TEXT)).otherwise(editing | (F.col("role").isin(pages.TEXT_ENTRY) & ~_is("aria-readonly", "true")))
    tab = F.regexp_extract(F.col("attrs")["tabindex"], r"\A\s*([+-]?[0-9]{1,9})", 1).try_cast("int")
    focusable = F.when(tab.isNotNull(), tab >= 0).when(tag.isin("a", "area"), _has("href")).when(tag.isin("button", "input", "select", "textarea", "summary"), ~disabled).otherwise(_is("contenteditable", "true"))
    value = (
        F.when(kind.isin("password", "file"), None).when(kind.isin("checkbox", "radio"), F.when(_has("checked"), "checked").otherwise("unchecked")).when(tag == "input", F.substring(_attr("value"), 1, pages.TEXT_CAP))
        .when(tag == "textarea", F.substring(F.nullif(F.col("own_text"), F.lit("")), 1, pages.TEXT_CAP))
        .when(tag == "select", F.substring(F.regexp_replace(F.col("chosen"), f"\\A{SPACE}|{SPACE}\\z", ""), 1, pages.TEXT_CAP))
    )
    refused, flagged = tag.isin(CONTROLS) & _refused(), _is("aria-invalid", "true")
    own = rows_with.select(
        "page_id", "ord", "last", "tag", "role", name().alias("name"), "text",
        F.coalesce("heard_description", _shown("title"), F.lit("")).alias("description"), value.alias("value"), kind.alias("input_type"),
        F.nullif(F.coalesce(F.col("attrs")["name"], F.col("attrs")["id"]), F.lit("")).alias("field_name"), _attr("placeholder").alias("placeholder"), _attr("autocomplete").alias("autocomplete"),
        (F.col("role").isin(pages.INTERACTIVE) | tag.isin("summary", "label") | ((tag == "a") & _has("href")) | _has("onclick")).alias("interactive"),
        focusable.alias("focusable"), editable.alias("editable"), disabled.alias("disabled"), (F.col("gone") | F.coalesce(kind == "hidden", F.lit(False))).alias("hidden"),
        (tag.isin(pages.IMAGE_TAGS) | F.coalesce(F.col("attrs")["style"].rlike(r"(?i)url\("), F.lit(False))).alias("paints"), (_has("required") | _is("aria-required", "true")).alias("required"),
        (refused | flagged).alias("invalid"),
        F.when(refused | flagged, F.coalesce("error", "description", F.when(refused, REFUSED))).alias("message"), "options",
    ).where(tag != "title")
    kept = own.where(F.col("interactive") | F.col("role").isin(pages.INFORMATIVE) | F.col("paints") | (F.col("name") != "") | F.col("text").isNotNull())
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).where(F.col("n") <= pages.NODE_CAP)
    kept = stored(kept, "kept-elements")

    point = kept.select("page_id", F.col("ord").alias("at"))
    above = inside(point, kept.where("last > ord").select("page_id", "ord", "last")).where("ord < at").groupBy("page_id", "at").agg(F.max("ord").alias("up"))
    parent = above.join(kept.select("page_id", F.col("ord").alias("up"), F.col("n").alias("parent")), ["page_id", "up"]).select("page_id", F.col("at").alias("ord"), "parent")
    control = kept.where("editable or interactive").select("page_id", F.col("ord").alias("at"))
    # an element that is its own form is no control of it but stands in it
    form = inside(control, rows.where("tag = 'form'").select("page_id", "ord", "last")).groupBy("page_id", "at").agg(F.max("ord").alias("form"))
    nth = form.groupBy("page_id", "form").agg(F.min("at").alias("first")).select("page_id", "form", F.row_number().over(Window.partitionBy("page_id").orderBy("first")).alias("form_id"))
    form = form.join(nth, ["page_id", "form"]).select("page_id", F.col("at").alias("ord"), "form_id")
    return kept.join(parent, KEY, "left").join(form, KEY, "left").withColumn("form_id", F.coalesce("form_id", F.when(F.col("editable"), 0))).select(
        "page_id", "n", "ord", "parent", "tag", "role", "name", "text", "description", "value", "input_type", "field_name", "placeholder", "autocomplete", "interactive", "focusable",
        "editable", "disabled", "hidden", "paints", "required", "invalid", "message", "options", "form_id",
    )
