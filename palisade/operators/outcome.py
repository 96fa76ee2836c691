"""What a step did to a page: elements keep their ids from one observation to the next, and each
observation is held against the one before.

elements: (run, version, document, node, n, role, name, text, invalid, message), one row an element of an
observation. ``version`` counts a run's observations by one, ``document`` changes when a page is loaded anew, ``node`` is
what the browser calls the same element in two observations of a document, n its place.
steps: (run, version, kind, submits, place, typed), the action that led to the observation, where it stands, and the nodes
that text went into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .detect_text import sanitized
from .loops import expects_change

# Roles that say something went wrong or changed; characters of what they say.
NOTICE_ROLES, NOTICE_CHARS = ["alert", "alertdialog", "status"], 200
# Notes and hints of each outcome.
NOTES = {
    "refused": "the page refused {id}", "message": "the page showed a new message", "end": "the page would not scroll any further", "unchanged": "the last action changed nothing",
}
HINTS = {
    "refused": 'The page is now refusing {id}{reason}. Put something different in that field. Submitting again unchanged will fail the same way.',
    "message": 'The page put up a new message after that step: "{said}". Respond to what it says instead of repeating the last action.',
    "end": "That scroll did not move the page — you are already at the end of it. Everything there is to see is in this view.",
    "unchanged": "That {action} changed nothing — same address, same page, same elements. It did not work. Choose a different element or a different route rather than trying it again.",
}

STEP = ["run", "version"]


def identified(elements: DataFrame) -> DataFrame:
    """Elements with ``element_id``: numbers by first appearance in a document (version, then place), kept
    as long as the document lasts, an absence included. A row without run, version or node goes."""
    rows = elements.dropna(subset=[*STEP, "node"])
    key = ["run", "document", "node"]
    first = rows.groupBy(*key).agg(F.min(F.struct("version", "n")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("run", "document").orderBy("first", "node")) - 1
    ids = first.select(*key, F.concat(F.lit("el_"), nth.cast("string")).alias("element_id"))
    same = (F.col("document").eqNullSafe(F.col("d"))) & (F.col("run") == F.col("r")) & (F.col("node") == F.col("k"))
    ids = ids.select(F.col("run").alias("r"), F.col("document").alias("d"), F.col("node").alias("k"), "element_id")
    return rows.join(ids, same).drop("r", "d", "k")


def registry(elements: DataFrame) -> DataFrame:
    """(run, version, live, minted, returned, dropped): of each observation its elements, those never seen before in
    the document, those back after an absence (they keep their id, which resolves no more), and those
    of the observation before in the same document that are gone."""
    rows = elements.dropna(subset=[*STEP, "node"])
    by = Window.partitionBy("run", "document", "node").orderBy("version")
    rows = rows.select(*STEP, "document", F.lag("version").over(by).alias("was"), F.lead("version").over(by).alias("next"))
    here = rows.groupBy(*STEP, "document").agg(
        F.count("*").alias("live"), F.count_if(F.col("was").isNull()).alias("minted"), F.count_if(F.col("was") < F.col("version") - 1).alias("returned"),
        F.count_if(F.coalesce(F.col("next") > F.col("version") + 1, F.lit(True))).alias("leaving"),
    )
    before = here.select("run", (F.col("version") + 1).alias("version"), F.col("document").alias("left"), "leaving")
    gone = F.when(F.col("document").eqNullSafe(F.col("left")), F.coalesce("leaving", F.lit(0))).otherwise(F.lit(0))
    return here.drop("leaving").join(before, STEP, "left").select(*STEP, "live", "minted", "returned", gone.cast("long").alias("dropped"))


def _notice() -> Column:
    return F.nullif(F.substring(F.trim(F.coalesce("text", "name")), 1, NOTICE_CHARS), F.lit(""))


def outcomes(elements: DataFrame, steps: DataFrame) -> DataFrame:
    """(run, version, kind, element_id, said, note, action): of each step the most telling of: a field newly refused (first one
    that was typed into), a new message, nothing moved although the action should have moved something. A step
    without an observation before it, and one of which nothing is to be said, has a null kind. What the page
    says is raw here; ``hinted`` makes it fit to send. Steps without run or version go."""
    # three branches read the elements and two the steps with their shapes
    seen = stored(identified(elements), "seen")
    by = Window.partitionBy("run", "element_id").orderBy("version")
    refused = F.coalesce("invalid", F.lit(False))
    was = F.lag(F.struct("version", refused.alias("invalid"))).over(by)
    held = F.coalesce((was["version"] == F.col("version") - 1) & was["invalid"], F.lit(False))
    fresh = seen.withColumn("fresh", refused & ~held).where("fresh")
    typed = steps.select(*STEP, F.explode("typed").alias("node")).distinct().withColumn("touched", F.lit(True))
    culprit = fresh.join(typed, [*STEP, "node"], "left").groupBy(*STEP).agg(F.min_by(F.struct("element_id", "message"), F.struct(F.col("touched").isNull(), "n")).alias("culprit"))

    notices = seen.where(F.col("role").isin(NOTICE_ROLES)).select(*STEP, "n", _notice().alias("said")).where("said is not null").groupBy(*STEP, "said").agg(F.min("n").alias("n"))
    earlier = F.lag("version").over(Window.partitionBy("run", "said").orderBy("version"))
    notices = notices.withColumn("new", ~F.coalesce(earlier == F.col("version") - 1, F.lit(False))).where("new").groupBy(*STEP).agg(F.min_by("said", "n").alias("notice"))

    # equal lists give equal sums; a row counts with its place, so order matters
    row = F.struct("n", "element_id", "role", F.coalesce("name", F.lit("")))
    shape = seen.groupBy(*STEP).agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(row)).alias("a"), F.sum(F.hash(row).cast("long")).alias("b")).alias("shape"))
    now = stored(steps.dropna(subset=STEP).join(shape, STEP, "left"), "steps")
    before = now.select("run", (F.col("version") + 1).alias("version"), F.struct("place", "shape").alias("before"))
    rows = now.withColumn("now", F.struct("place", "shape")).join(before, STEP, "left").join(culprit, STEP, "left").join(notices, STEP, "left")
    still = expects_change(F.col("kind"), F.coalesce("submits", F.lit(False))) & F.col("now").eqNullSafe(F.col("before"))
    found = (
        F.when(F.col("before").isNull(), None).when(F.col("culprit").isNotNull(), "refused").when(F.col("notice").isNotNull(), "message")
        .when(still, F.when(F.col("kind") == "scroll", "end").otherwise("unchanged"))
    )
    rows = rows.select(*STEP, found.alias("found"), "culprit", "notice", F.col("kind").alias("action"))
    own = F.when(F.col("found") == "refused", F.col("culprit.element_id"))
    note = F.when(F.col("found") == "refused", F.concat(F.lit(NOTES["refused"].removesuffix("{id}")), own))
    for k in ("message", "end", "unchanged"):
        note = note.when(F.col("found") == k, NOTES[k])
    said = F.when(F.col("found") == "refused", F.col("culprit.message")).when(F.col("found") == "message", F.col("notice"))
    return rows.select(*STEP, F.col("found").alias("kind"), own.alias("element_id"), said.alias("said"), note.alias("note"), "action")


def hinted(found: DataFrame) -> DataFrame:
    """``outcomes`` with ``hint``: the sentence for the next step, what the page said sanitised in it."""
    safe = F.when(F.col("said").isNotNull(), sanitized(F.col("said")))
    fill = lambda k, **parts: F.concat(*_filled(HINTS[k], parts))
    hint = (
        F.when(F.col("kind") == "refused", fill("refused", id=F.col("element_id"), reason=F.when(F.col("safe").isNull(), "").otherwise(F.concat(F.lit(': "'), "safe", F.lit('"')))))
        .when(F.col("kind") == "message", fill("message", said=F.col("safe"))).when(F.col("kind") == "end", HINTS["end"])
        .when(F.col("kind") == "unchanged", fill("unchanged", action=F.replace("action", F.lit("_"), F.lit(" "))))
    )
    return found.withColumn("safe", safe).withColumn("hint", hint).drop("safe", "said")


def _filled(sentence: str, parts: dict[str, Column]) -> list[Column]:
    out, rest = [], sentence
    for name, value in parts.items():
        head, rest = rest.split("{" + name + "}")
        out += [F.lit(head), value]
    return [*out, F.lit(rest)]
