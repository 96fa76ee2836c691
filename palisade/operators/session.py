"""What a run keeps beside its page: supplied values, the tokens it offers, what it erases
from outgoing text, and the small decisions around a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let
from ..taxonomy import LEAST_SEARCHABLE
from .detect_text import escaped, search_length, search_pattern, trimmed
from .validate import type_of_handle

# Lifetimes that are never offered, the slot of the provider's own key.
EPHEMERAL, KEY_SLOT = "ephemeral", "provider_key"
# Roles that paint a picture, the least surface worth reading, rows kept of a page.
PICTURE_ROLES = ["img", "image", "figure", "application", "graphics-document", "graphics-object", "graphics-symbol"]
LEAST_SURFACE, NODE_CAP = (16, 10), 1500
# Labels of controls that may start a download.
DOWNLOAD_LABEL = r"\b(?:download|save|export|admit\s*card|hall\s*ticket|pdf)\b"
# Roles by what a visual label has, in order, and sensitive types likewise.
LABEL_ROLES = {
    "face": "img", "photograph": "img", "signature": "img", "checkbox": "checkbox", "dropdown": "combobox", "search": "searchbox", "text input": "textbox",
    "link": "link", "button": "button",
}
LABEL_TYPES = {"signature": "signature", "face": "face", "photograph": "face", "person": "face"}
# Categories of input that a model may ask the user for.
CATEGORIES = ["otp", "captcha", "password", "security_answer", "missing_profile_field", "confirmation", "other"]
# Fields shown of a group, consecutive unusable replies that end a run, milliseconds to see a download and to see its end.
SHOWN_FIELDS, MOST_BAD_REPLIES, DISCOVERY_MS, COMPLETION_MS = 25, 3, 3_000, 60_000
#: Events of downloads that one task takes.
TASK_EVENTS = 250_000
# How a finding was hidden and found, in words.
HIDDEN_AS = {
    "mask_solid": "covered with a solid block", "blur": "blurred and pixelated", "placeholder": "replaced with a name-only label", "synthetic": "swapped for a same-shape fake",
    "drop": "removed from what was sent", "none": "left as it was",
}
FOUND_BY = {
    "known_value": "matched a value in your vault", "structural": "the field itself says what it holds", "pattern": "format and checksum", "semantic": "read from the surrounding words",
    "vision_face": "face detection",
}


def named(of: Column, table: dict[str, str], other: Column) -> Column:
    """The table's value for a key, else ``other``."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), of), other)


def by_content(label: Column, table: dict[str, str], other: str | None) -> Column:
    """The value of the first key that the label contains, in any case."""
    return reduce(lambda rest, p: F.when(F.contains(F.lower(label), F.lit(p[0])), F.lit(p[1])).otherwise(rest), reversed(table.items()), F.lit(other).cast("string"))


# ---- supplied values ---------------------------------------------------------------------------
def supplied(answers: DataFrame) -> DataFrame:
    """answers (run, seq, requested, value, pii_type or null, origin or null): adds pii_type, token and
    aliases. A requested name stays the token if it begins with its type and is a plain
    name; else a token is made of the type and letters of a hash, and both names lead to it."""
    asked = F.upper(F.trim("requested"))
    kind = F.coalesce("pii_type", type_of_handle(asked), F.lit("secret_token"))
    letters = F.upper(F.translate(F.substring(F.md5(F.concat_ws("|", "run", "seq", asked)), 1, 10), "0123456789", "ghijklmnop"))
    rows = answers.withColumns({"pii_type": kind, "requested": asked})
    plain = F.startswith("requested", F.upper("pii_type")) & F.col("requested").rlike(r"\A[A-Z][A-Z0-9_]{2,80}\z")
    rows = rows.withColumn("token", F.when(plain, F.col("requested")).otherwise(F.concat(F.upper("pii_type"), F.lit("_LOCAL_"), letters)))
    return rows.withColumn("aliases", F.array_distinct(F.array("token", "requested")))


def latest_supplied(entries: DataFrame) -> DataFrame:
    """One entry a run and token, the last supplied."""
    rest = [c for c in entries.columns if c not in ("run", "token")]
    return entries.groupBy("run", "token").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("run", "token", *[F.col(f"e.{c}").alias(c) for c in rest])


def found_supplied(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked (k, run, handle, origin) with the token that answers it: the entry of that name, if it
    belongs to the origin or to none; without such a name the only entry of the handle's type."""
    handle = F.upper(F.trim("handle"))
    own = asked.withColumns({"name": handle, "kind": type_of_handle(handle)})
    names = entries.select("run", F.explode("aliases").alias("name"), F.struct("token", F.col("origin").alias("at")).alias("direct"), "seq")
    names = names.groupBy("run", "name").agg(F.max_by("direct", "seq").alias("direct"))
    kinds = entries.select("run", F.col("pii_type").alias("kind"), F.col("token").alias("t"), F.col("origin").alias("at"))
    here = lambda at, origin: at.isNull() | origin.isNull() | (at == origin)
    direct = own.join(names, ["run", "name"], "left")
    alike = own.join(kinds, ["run", "kind"]).where(here(F.col("at"), F.col("origin"))).groupBy("k").agg(F.count("*").alias("n"), F.min("t").alias("t"))
    both = direct.join(alike, "k", "left")
    by_name = F.when(here(F.col("direct.at"), F.col("origin")), F.col("direct.token"))
    return both.select("k", F.when(F.col("direct").isNotNull(), by_name).otherwise(F.when(F.col("n") == 1, F.col("t"))).alias("token"))


def name_part(handle: Column, full: Column) -> Column:
    """The given or family name that a handle asks for, of a full name; no family name of one word."""
    parts = F.filter(F.split(F.trim(full), r"\s+"), lambda w: w != "")
    given = F.startswith(F.upper(handle), F.lit("GIVEN_NAME"))
    family = F.startswith(F.upper(handle), F.lit("FAMILY_NAME"))
    rest = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " "))
    return F.when(given, F.get(parts, F.lit(0))).when(family, rest)


# ---- what is offered and what is erased ---------------------------------------------------------
def offered(entries: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows (origin, token, pii_type, length) that a page of an origin is offered: values bound to it or
    to none, not ephemeral, not the provider's key; of equal tokens the first. entries:
    (seq, pii_type, slot, value, site, lifetime)."""
    usable = entries.where((F.col("lifetime") != EPHEMERAL) & (F.col("slot") != KEY_SLOT)).withColumn("token", F.upper(F.concat_ws("_", "pii_type", "slot")))
    free = usable.where("site is null")
    bound = usable.where("site is not null").join(origins.select(F.col("origin").alias("site")).distinct(), "site").select(F.col("site").alias("origin"), "token", "pii_type", "value", "seq")
    # unbound values go to every origin, as one array that is joined once
    shared = free.agg(F.collect_list(F.struct("token", "pii_type", "value", "seq")).alias("all"))
    everywhere = origins.select("origin").distinct().withColumn("one", F.lit(1)).join(shared.withColumn("one", F.lit(1)), "one").select("origin", F.inline("all"))
    first = Window.partitionBy("origin", "token").orderBy("seq")
    rows = everywhere.unionByName(bound).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return rows.select("origin", "token", "pii_type", F.length("value").alias("length"))


def substitutions(known: DataFrame) -> DataFrame:
    """known (grp, source, seq, pii_type, literal, token): by group the array of (pattern, replacement)
    in order of use.

    Sources in order are edits (0: of equal ones the last token counts), findings (1) and stored values (2;
    they count where no earlier source has the type and literal). A token that holds any literal, looked for
    as the token's own type is, is replaced by TYPE_n, n the number of such entries before; a token has one
    replacement, its last entry's. Longest pattern first, then the tokens to be replaced where they stand already.
    """
    rows = known.withColumn("literal", trimmed(F.col("literal"))).where((F.length("literal") >= LEAST_SEARCHABLE) & ((F.col("source") > 0) | (F.col("token") != "")))
    edit = F.when(F.col("source") == 0, F.col("seq"))
    once = rows.groupBy("grp", "pii_type", "literal").agg(
        F.min(F.struct("source", "seq")).alias("at"), F.coalesce(F.max_by("token", edit), F.min_by("token", F.struct("source", "seq"))).alias("token")
    )
    own = F.struct("at", "pii_type", "literal", "token", search_pattern(F.col("pii_type"), F.col("literal")).alias("pattern"), search_length(F.col("pii_type"), F.col("literal")).alias("length"))
    all_of = once.groupBy("grp").agg(F.array_sort(F.collect_list(own)).alias("s"))
    leaks = F.transform("s", lambda x: F.exists("s", lambda y: F.coalesce(F.regexp_like(x["token"], search_pattern(x["pii_type"], y["literal"])), F.lit(False))))
    marked = all_of.withColumn("leaks", leaks)
    named = lambda x, i: F.concat(F.upper(x["pii_type"]), F.lit("_"), F.size(F.filter(F.slice("leaks", 1, i), lambda b: b)))
    unsafe = F.filter(F.transform("s", lambda x, i: F.struct(F.get("leaks", i).alias("leaks"), x["token"].alias("token"), named(x, i).alias("safe"))), lambda x: x["leaks"])
    marked = marked.withColumn("unsafe", unsafe).withColumn("tokens", F.array_distinct(F.transform("unsafe", lambda x: x["token"])))
    safe = lambda t: F.try_element_at(F.filter("unsafe", lambda u: u["token"] == t), F.lit(-1))["safe"]
    plain = F.transform(F.filter("s", lambda x: x["pattern"].isNotNull()), lambda x: F.struct((-x["length"]).alias("longest"), x["at"].alias("at"), x["pattern"].alias("pattern"), F.coalesce(safe(x["token"]), x["token"]).alias("replacement")))
    first = F.transform(F.array_sort(plain), lambda x: F.struct(x["pattern"].alias("pattern"), x["replacement"].alias("replacement")))
    rewrites = F.transform("tokens", lambda t: F.struct(F.concat(F.lit("(?iu)"), escaped(t)).alias("pattern"), safe(t).alias("replacement")))
    return marked.select("grp", F.concat(first, rewrites).alias("substitutions"))


def scrubbed(text: Column, subs: Column) -> Column:
    """The text after each substitution in turn; replacements are taken literally."""
    literal = lambda r: F.regexp_replace(r, r"([\\$])", r"\\$1")
    return F.aggregate(subs, text, lambda t, s: F.regexp_replace(t, s["pattern"], literal(s["replacement"])))


# ---- small decisions ------------------------------------------------------------------------------
def rejection(pii_type: Column, label: Column, value: Column) -> Column:
    """Why a value can't be kept: empty, the name of its type, its own label; null if it can."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[\s_-]+", "")
    return (
        F.when(F.trim(value) == "", "empty").when(bare(F.trim(value)) == bare(pii_type), "type_name")
        .when((F.trim(label) != "") & (bare(F.trim(value)) == bare(label)), "label")
    )


def fit(need_mb: Column, ram_gb: Column) -> Column:
    """Whether models fit into half of the memory."""
    budget = ram_gb * 512.0
    return F.when(ram_gb.isNull(), F.when(need_mb > 700, "tight").otherwise("comfortable")).when(need_mb > budget, "over-budget").when(need_mb > budget * 0.6, "tight").otherwise("comfortable")


def is_surface(hidden: Column, in_viewport: Column, paints: Column, role: Column, width: Column, height: Column) -> Column:
    """Whether text could be hiding from the markup in an element's picture."""
    return ~hidden & in_viewport & (paints | role.isin(PICTURE_ROLES)) & (width >= LEAST_SURFACE[0]) & (height >= LEAST_SURFACE[1])


def scaled_out(x: Column, y: Column, w: Column, h: Column, by: Column) -> Column:
    """A rectangle in pixels that covers the scaled one: floor of its origin, ceiling of its size."""
    return F.struct(F.floor(x * by).alias("x"), F.floor(y * by).alias("y"), F.ceil(w * by).alias("w"), F.ceil(h * by).alias("h"))


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def bucket_line(label: Column, fields: Column, most: int = SHOWN_FIELDS) -> Column:
    """A group's first fields in one line, and how many more there are; null for none."""
    rest = F.size(fields) - most
    shown = F.concat(label, F.lit(": "), F.array_join(F.slice(fields, 1, most), "; "))
    return F.when(F.size(fields) > 0, F.when(rest > 0, F.concat(shown, F.lit(" …and "), rest, F.lit(" more"))).otherwise(shown))


def category(raw: Column) -> Column:
    own = F.regexp_replace(F.lower(F.trim(raw)), r"[\s-]", "_")
    return F.when(own.isin(CATEGORIES), own).otherwise("other")


def value_ref(value: Column) -> Column:
    """A value in a reply (JSON) as struct(kind, text); kind 'failed' says why in text."""
    field = lambda n: F.get_json_object(value, f"$.{n}")
    said = lambda *names: F.coalesce(*[F.nullif(F.trim(field(n)), F.lit("")) for n in names])
    ref = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    handle = said("placeholderId", "placeholder_id")
    return (
        F.when(F.startswith(value, F.lit('"')), ref("literal", F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")))
        .when(~F.startswith(value, F.lit("{")), ref("failed", F.lit("string or object")))
        .when(said("kind") == "literal", F.when(field("text").isNull(), ref("failed", F.lit("text"))).otherwise(ref("literal", field("text"))))
        .when(said("kind") == "placeholder", F.when(handle.isNull(), ref("failed", F.lit("placeholderId"))).otherwise(ref("placeholder", handle)))
        .when(said("text").isNotNull(), ref("literal", said("text"))).when(said("placeholderId").isNotNull(), ref("placeholder", said("placeholderId")))
        .otherwise(ref("failed", F.lit("kind")))
    )


def described(findings: DataFrame) -> DataFrame:
    """findings (grp, seq, pii_type, redaction, detectors): by type and redaction how many, how they
    were hidden and the first finding's strongest evidence; in order of first appearance."""
    first = F.get("detectors", F.lit(0))
    evidence = F.when(F.array_contains("detectors", "known_value"), "known_value").otherwise(F.coalesce(first, F.lit("unknown")))
    rows = findings.where("redaction <> 'none'").withColumn("evidence", evidence)
    rows = rows.groupBy("grp", "pii_type", "redaction").agg(F.count("*").alias("n"), F.min_by("evidence", "seq").alias("evidence"), F.min("seq").alias("first"))
    return rows.select(
        "grp", F.replace("pii_type", F.lit("_"), F.lit(" ")).alias("what"), named(F.col("redaction"), HIDDEN_AS, F.col("redaction")).alias("how"),
        named(F.col("evidence"), FOUND_BY, F.col("evidence")).alias("found_by"), "n", F.row_number().over(Window.partitionBy("grp").orderBy("first")).alias("place"),
    )


def bad_reply_ends(replies: DataFrame) -> DataFrame:
    """replies (run, step, ok): the first step of each run at which more than ``MOST_BAD_REPLIES``
    unusable replies have followed one another."""
    goods = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("run").orderBy("step"))
    island = replies.withColumn("island", goods).where("not ok")
    nth = F.row_number().over(Window.partitionBy("run", "island").orderBy("step"))
    return island.withColumn("nth", nth).where(F.col("nth") == MOST_BAD_REPLIES + 1).groupBy("run").agg(F.min("step").alias("failed_at"))


def download_outcomes(waits: DataFrame, events: DataFrame) -> DataFrame:
    """waits (k, at_ms); events (k, id, at_ms, kind: created, complete, interrupted): what a wait ends
    with. A download must begin within ``DISCOVERY_MS`` (or have begun); the first completed
    one ends the wait, else the first failed one, else time does, as failed."""
    # by their number, not by the session's count of tasks: what one task sorts does not grow with the tables
    tasks = max(waits.sparkSession.sparkContext.defaultParallelism, -(-events.count() // TASK_EVENTS))
    rows = waits.repartition(tasks, "k").join(events.withColumnRenamed("at_ms", "e_ms").repartition(tasks, "k"), "k", "left")
    began = F.min(F.when(F.col("kind") == "created", F.col("e_ms"))).over(Window.partitionBy("k", "id"))
    # what is said of a download before it exists doesn't count; a later word on it does
    counts = F.col("e_ms") >= F.col("began")
    seen = rows.withColumn("began", began).groupBy("k", "id", "at_ms", "began").agg(
        F.min(F.when((F.col("kind") == "complete") & counts, F.col("e_ms"))).alias("done"), F.min(F.when((F.col("kind") == "interrupted") & counts, F.col("e_ms"))).alias("lost")
    )
    found = seen.groupBy("k", "at_ms").agg(F.min("began").alias("began"), F.min("done").alias("done"), F.min("lost").alias("lost"))
    start = F.greatest("began", "at_ms")
    end = start + COMPLETION_MS
    outcome = (
        F.when(F.col("began").isNull() | (F.col("began") >= F.col("at_ms") + DISCOVERY_MS), "none")
        .when((F.col("done") < end) & (F.col("lost").isNull() | (F.greatest("done", start) <= F.greatest("lost", start))), "complete").otherwise("failed")
    )
    return found.select("k", outcome.alias("outcome"))


def host_pattern(url: Column) -> Column:
    """An address's scheme and host for a permission; null if it is none."""
    parts = lambda n: F.lower(F.regexp_extract(url, r"(?i)\A([a-z][a-z0-9+.-]*):/*(?:[^/?#@]*@)?([^/?#\s]+)", n))
    return F.when(parts(2) != "", F.concat(parts(1), F.lit("://"), parts(2), F.lit("/*")))


def joined_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, r"/+\z", ""), path)


def line_variants(words: Column) -> Column:
    """The texts under which a line of recognised words is searched: spaced and closed up."""
    return F.array_distinct(F.array(F.array_join(words, " "), F.array_join(words, "")))


def shape(elements: DataFrame) -> DataFrame:
    """elements (page_id, ord, id, role, name): by page its count and a hash of its elements in order."""
    row = F.concat_ws("|", "id", "role", "name")
    return elements.groupBy("page_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("e")))), lambda x: x["e"]), "\n")).alias("shape"))


def strongest(signals: Column, least: float = 0.5) -> Column:
    """The type of the strongest of a field's signals (pii_type, confidence), the first of equals; null below ``least``."""
    ranked = F.transform(signals, lambda s, i: F.struct((-s["confidence"]).alias("c"), i.alias("i"), s["pii_type"].alias("t")))
    return let(F.array_min(F.filter(ranked, lambda s: s["c"] <= -least)), lambda s: s["t"])
