"""Verdicts on proposed actions: the first check that refuses decides, in one CASE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..taxonomy import INPUT_TYPES, POLICIES

# Inputs that hold no text, identifiers that stand in for each other, types that must be declared.
NON_TEXT = ["checkbox", "radio", "file", "range", "color", "button", "submit", "reset", "image", "hidden"]
INTERCHANGEABLE = ["roll_number", "registration_number", "person_name", "given_name", "family_name", "email", "phone"]
MUST_DECLARE = ["api_key", "secret_token"]
# Types that the user gives and a model never makes up, and how sure markup must be of one.
NEVER_INVENTED = [
    "person_name", "given_name", "family_name", "address", "email", "phone", "date_of_birth", "aadhaar", "pan", "passport", "voter_id", "driving_licence", "gstin", "credit_card",
    "bank_account", "ifsc", "upi_id", "roll_number", "registration_number", "vehicle_number", "password", "otp", "cvv", "api_key", "secret_token",
]
LEAST_DECLARED = 0.6
# Dispatched actions allowed in a trailing window.
RATE_LIMIT, RATE_WINDOW_MS = 60, 10_000


def type_of_handle(handle: Column) -> Column:
    """The longest type name that a handle begins with."""
    names = sorted((p.pii_type for p in POLICIES), key=len)
    return reduce(lambda rest, n: F.when(F.upper(handle).startswith(n.upper()), n).otherwise(rest), names, F.lit(None).cast("string"))


def field_accepts(pii_type: Column, input_type: Column, editable: Column, declared: Column) -> Column:
    """Whether a field's own markup agrees with a value's type. declared: array of types."""
    agrees = F.array_contains(declared, pii_type)
    swap = F.array(*map(F.lit, INTERCHANGEABLE))
    return (
        F.when(pii_type.isin(MUST_DECLARE) & ~agrees, F.lit(False))
        .when(pii_type == "password", F.coalesce(input_type == "password", F.lit(False)))
        .when(~editable | F.coalesce(input_type, F.lit("text")).isin(NON_TEXT), F.lit(False))
        .when((F.size(declared) == 0) | agrees, F.lit(True))
        .otherwise(pii_type.isin(INTERCHANGEABLE) & (F.size(F.array_except(declared, swap)) == 0))
    )


def site_verdict(confirm: Column, site: Column, origin: Column) -> Column:
    return F.when(~confirm, "use").when(F.coalesce(site, F.lit("")) == "", "bind").when(site == origin, "use").otherwise("refuse")


def resolved(actions: DataFrame, store: DataFrame) -> DataFrame:
    """``actions`` with the stored value that a handle names: exactly, or as the only one
    of the type that the handle begins with. Adds pii_type, site, confirm (of an exact
    name alone), candidates."""
    exact = store.select(F.upper("handle").alias("__h"), F.col("pii_type").alias("__exact"), "site", "confirm")
    by_type = store.groupBy(F.col("pii_type").alias("__t")).agg(F.count("*").alias("candidates"))
    own = actions.withColumns({"__h": F.upper("handle"), "__t": type_of_handle(F.col("handle"))})
    return own.join(exact, "__h", "left").join(by_type, "__t", "left").withColumn(
        "pii_type", F.coalesce("__exact", F.when(F.col("candidates") == 1, F.col("__t")))
    ).drop("__h", "__t", "__exact")


def asks_identity(signals: Column) -> Column:
    """Whether a field's own markup (signals: pii_type, confidence) asks for what is never made up."""
    return F.exists(signals, lambda s: (s["confidence"] >= LEAST_DECLARED) & s["pii_type"].isin(NEVER_INVENTED))


def verdicts(actions: DataFrame, page: DataFrame, store: DataFrame, viewport: tuple[float, float] = (1280, 800)) -> DataFrame:
    """actions (type, target, value_kind, text, handle, url, keys, x, y, recent, origin) with code:
    ok or why not. recent: actions dispatched within the rate window before.

    page: (target, hidden, disabled, editable, asks_identity, input_type); store:
    (handle, pii_type, site, confirm). One page and store a call: both are small by
    their nature (a page has 1500 elements at most) and joined by key."""
    rows = resolved(actions, store).join(page.withColumn("__there", F.lit(True)), "target", "left")
    c = F.col
    declared = F.when(c("input_type").isin(list(INPUT_TYPES)), F.array(F.element_at(F.create_map(*[F.lit(x) for p in INPUT_TYPES.items() for x in p]), c("input_type")))).otherwise(F.array().cast("array<string>"))
    typed = (
        F.when(~c("editable"), "not_interactable")
        .when(c("value_kind") == "literal", F.when(c("asks_identity") & (F.trim(F.coalesce("text", F.lit(""))) != ""), "secret_target_mismatch").otherwise("ok"))
        .when(c("pii_type").isNull(), "unresolvable_placeholder")
        .when(~field_accepts(c("pii_type"), c("input_type"), c("editable"), declared), "secret_target_mismatch")
        .when(c("confirm").isNotNull() & (site_verdict(c("confirm"), c("site"), c("origin")) == "refuse"), "wrong_site").otherwise("ok")
    )
    inside = c("x").between(0, viewport[0]) & c("y").between(0, viewport[1])
    code = (
        F.when(F.coalesce("recent", F.lit(0)) >= RATE_LIMIT, "rate_limited")
        .when(c("type").isin("noop", "stop", "request_user_input", "go_back", "go_forward"), "ok")
        .when(c("type") == "goto_url", F.when(~c("url").rlike("(?i)^[a-z][a-z0-9+.-]*:"), "schema").when(~c("url").rlike("(?i)^https?:"), "url_not_allowed").otherwise("ok"))
        .when(c("type") == "key_press", F.when(F.trim(F.coalesce("keys", F.lit(""))) == "", "schema").otherwise("ok"))
        .when(c("type") == "click_point", F.when(F.coalesce(inside, F.lit(False)), "ok").otherwise("schema"))
        .when((c("type") == "scroll") & c("target").isNull(), "ok")
        .when(~c("type").isin("click", "hover", "scroll", "select", "type"), "schema")
        .when(c("__there").isNull(), "unknown_target").when(c("type").isin("scroll", "hover"), "ok")
        .when(c("hidden") | c("disabled"), "not_interactable").when(c("type") == "click", "ok")
        .when(c("type") == "select", F.when((c("value_kind") == "placeholder") & c("pii_type").isNull(), "unresolvable_placeholder").otherwise("ok"))
        .otherwise(typed)
    )
    return rows.withColumn("code", code).drop("__there")


def first_refusals(judged: DataFrame, run: str, order: str) -> DataFrame:
    """By run the place of the first action that is refused, and why; its number of actions and ok if none is."""
    nth = F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1
    rows = judged.withColumn("nth", nth).groupBy(run).agg(F.min(F.when(F.col("code") != "ok", F.struct("nth", "code"))).alias("f"), F.count("*").alias("n"))
    return rows.select(run, F.coalesce(F.col("f.nth").cast("long"), "n").alias("index"), F.coalesce("f.code", F.lit("ok")).alias("code"))
