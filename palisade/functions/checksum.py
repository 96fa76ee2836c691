"""Checks of identifiers, as Column expressions. Null in, null or false out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..taxonomy import VERHOEFF_PLACE, VERHOEFF_PRODUCT
from .dialect import JAVA_SPACE


def normalize_digits(v: Column) -> Column:
    """Without white space and hyphens."""
    return F.regexp_replace(v, f"[{JAVA_SPACE}-]", "")


def _upper(v: Column) -> Column:
    return F.upper(F.trim(v))


def verhoeff_valid(digits: Column) -> Column:
    """A digit string, its check digit included, whose Verhoeff sum is 0."""
    places, products = F.lit("".join(VERHOEFF_PLACE)), F.lit("".join(VERHOEFF_PRODUCT))

    def step(acc: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, 1).cast("int")
        placed = F.substring(places, (k % 8) * 10 + digit + 1, 1).cast("int")
        return F.substring(products, acc * 10 + placed + 1, 1).cast("int")

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)
    return F.when(digits.rlike(r"\A[0-9]+\z"), total == 0).otherwise(F.lit(False))


def is_aadhaar(v: Column) -> Column:
    d = normalize_digits(v)
    return d.rlike(r"\A[2-9][0-9]{11}\z") & verhoeff_valid(d)


def luhn_valid(d: Column) -> Column:
    """Digits only, twelve at least, Luhn sum divisible by ten."""
    return F.when(d.rlike(r"\A[0-9]{12,}\z"), F.call_function("luhn_check", d)).otherwise(F.lit(False))


def is_payment_card(v: Column) -> Column:
    d = normalize_digits(v)
    return F.length(d).between(13, 19) & luhn_valid(d)


def is_pan(v: Column) -> Column:
    return _upper(v).rlike(r"\A[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]\z")


def is_ifsc(v: Column) -> Column:
    return _upper(v).rlike(r"\A[A-Z]{4}0[A-Z0-9]{6}\z")


def is_indian_mobile(v: Column) -> Column:
    return F.regexp_replace(normalize_digits(v), r"\A\+?91", "").rlike(r"\A[6-9][0-9]{9}\z")


def is_passport(v: Column) -> Column:
    return _upper(v).rlike(r"\A[A-PR-WY][1-9][0-9]{6}\z")


def is_gstin(v: Column) -> Column:
    """Shape, a state of 1 to 38 and an embedded PAN; the last character isn't checked."""
    u = _upper(v)
    return F.when(
        u.rlike(r"\A[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[A-Z0-9]\z"),
        F.substring(u, 1, 2).cast("int").between(1, 38) & is_pan(F.substring(u, 3, 10)),
    ).otherwise(F.lit(False))


def is_vehicle_number(v: Column) -> Column:
    return F.upper(normalize_digits(v)).rlike(r"\A[A-Z]{2}[0-9]{1,2}[A-Z]{0,3}[0-9]{4}\z")


def entropy(v: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars, n = F.split(v, ""), F.length(v)
    share = lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def looks_like_contextual_secret(v: Column) -> Column:
    t = F.trim(v)
    classes = sum((t.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    shaped = (
        F.length(t).between(16, 512)
        & ~t.rlike(r"(?i)\A(?:[A-Z]+_)*(?:LOCAL|HIDDEN)(?:_[A-Z]+)*\z")
        & ~t.rlike(r"(?i)\A(?:https?://|www\.)")
        & ~t.rlike(r"(?i)\.(?:js|css|png|jpe?g|svg|webp|woff2?)(?:\?|\z)")
        & (classes >= 2)
    )
    return F.when(shaped, entropy(t) >= 3.2).otherwise(F.lit(False))


def looks_like_portal_identifier(v: Column) -> Column:
    return v.rlike("[0-9]")


def looks_like_credential(v: Column, stop_words: list[str]) -> Column:
    return (F.length(v) >= 6) & ~F.lower(v).isin(stop_words) & (v.rlike("[0-9]") | (F.length(v) >= 12) | v.rlike("[^A-Za-z0-9]"))


VALIDATORS = {
    "gstin": is_gstin, "aadhaar": is_aadhaar, "payment_card": is_payment_card, "pan": is_pan, "passport": is_passport, "ifsc": is_ifsc,
    "indian_mobile": is_indian_mobile, "vehicle_number": is_vehicle_number, "contextual_secret": looks_like_contextual_secret,
    "portal_identifier": looks_like_portal_identifier,
}
