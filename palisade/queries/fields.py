"""Queries over form fields and known values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import re2, sql
from ..functions.spans import let
from ..operators import detect_text, fields
from ..sources.derived import dealt, id_candidates, spread, table
from ..taxonomy import AUTOCOMPLETE, AUTOCOMPLETE_CONFIDENCE, INPUT_CONFIDENCE, INPUT_TYPES, LABEL_RULES, PASSWORD_INPUT_CONFIDENCE, SEPARATOR_INSENSITIVE
from .registry import Registry
from .store import _ENTRY_SQL, entries

query = Registry()

#: Values that the derived field table takes in turn.
TYPES = ["text", "password", "email", "TEL", "number", "checkbox", "search"]
AUTO = ["off", "section-a name", "billing cc-number", "one-time-code", "", "username", "given-name", "bday", "organization", "shipping street-address"]
NAMES = ["txtAadharNo", "pan_number", "DOBField", "user.email", "qty", "roll-no", "card1Number", "firstName", "ddlState", "APIKey", "tokenValue", "gstNo"]
LABELS = ["Enter Aadhaar", "Permanent Address", "First name", "Subject", "Card number", "Mobile no", "", "Confirm password", "Vehicle", "Driver's licence", "Search", "IFSC code", "Date of birth"]

_pick = lambda values, k, n: f"[{', '.join(sql(v) for v in values)}][(({k}) % {n} + 1)::INT]"
FIELDS_SQL = f"""SELECT p_partkey AS k, {_pick(TYPES, 'p_partkey', len(TYPES))} AS input_type, {_pick(AUTO, 'p_partkey // 7', len(AUTO))} AS autocomplete,
  {_pick(NAMES, 'p_partkey // 3', len(NAMES))} AS field_name, {_pick(LABELS, 'p_partkey', len(LABELS))} AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS placeholder,
  p_size % 3 <> 0 AS editable FROM part"""


def field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")).select(
        k.alias("k"), pick(TYPES, k).alias("input_type"), pick(AUTO, F.floor(k / 7)).alias("autocomplete"), pick(NAMES, F.floor(k / 3)).alias("field_name"),
        pick(LABELS, k).alias("name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("placeholder"), (F.col("p_size") % 3 != 0).alias("editable"),
    )


_SPLIT = "field_name"
for _rx in (r"[_\-.\[\]]+",):
    _SPLIT = f"regexp_replace({_SPLIT}, {sql(_rx)}, ' ', 'g')"
for _rx in (r"([a-z0-9])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([A-Za-z])([0-9])"):
    _SPLIT = f"regexp_replace({_SPLIT}, {sql(_rx)}, '\\1 \\2', 'g')"
_SPLIT = f"CASE WHEN field_name <> '' THEN trim({_SPLIT}) END"
_case = lambda of, table: f"CASE {of} " + " ".join(f"WHEN {sql(a)} THEN {sql(b)}" for a, b in table.items()) + " END"
_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(said, {sql(re2(r.pattern, True))}) THEN {i}" for i, r in enumerate(LABEL_RULES)) + " END"
SIGNALS_SQL = f"""
  WITH f AS (SELECT *, concat_ws(' ', nullif(name, ''), nullif(placeholder, ''), {_SPLIT}) AS said FROM ({FIELDS_SQL})), l AS (SELECT *, {_LABEL} AS label FROM f),
  s AS (
    SELECT k, editable, 'input' AS evidence, {_case('lower(input_type)', INPUT_TYPES)} AS pii_type, CASE WHEN lower(input_type) = 'password' THEN {PASSWORD_INPUT_CONFIDENCE} ELSE {INPUT_CONFIDENCE} END::DOUBLE AS confidence FROM l
    UNION ALL SELECT k, editable, 'autocomplete', {_case("regexp_extract(lower(autocomplete), '[^ ]+$')", AUTOCOMPLETE)}, {AUTOCOMPLETE_CONFIDENCE}::DOUBLE FROM l
    UNION ALL SELECT k, editable, 'label', {_case('label', {str(i): r.pii_type for i, r in enumerate(LABEL_RULES)}).replace("WHEN '", 'WHEN ').replace("' THEN", ' THEN')}, {_case('label', {str(i): str(r.confidence) for i, r in enumerate(LABEL_RULES)}).replace("'", '')}::DOUBLE FROM l)
  SELECT * FROM s WHERE pii_type IS NOT NULL"""


def _signals():
    c = F.col
    return fields.signals(c("input_type"), c("autocomplete"), c("name"), c("placeholder"), c("field_name"))


@query(f"SELECT k, evidence, pii_type, confidence FROM ({SIGNALS_SQL})")
def field_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input type, autocomplete and label signals of each field."""
    return field_rows(spark, sf_dir).select("k", F.inline(_signals())).select("k", "evidence", "pii_type", F.col("confidence").cast("double").alias("confidence"))


@query(f"SELECT DISTINCT k FROM ({SIGNALS_SQL}) WHERE editable")
def declared_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editable fields whose markup declares something sensitive."""
    return field_rows(spark, sf_dir).where(F.col("editable") & (F.size(_signals()) > 0)).select("k")


@query(f"""
  WITH s AS ({SIGNALS_SQL}), m AS (SELECT k, list_distinct(list(pii_type)) AS declared FROM s GROUP BY k),
  o AS (SELECT k, declared, [ {_pick(['aadhaar', 'email', 'person_name', 'otp'], 'k', 4)} ] AS seen FROM m)
  SELECT k, len(list_intersect(declared, seen)) = 0 AS conflicting FROM o""")
def conflicting_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types against a detected one."""
    seen = F.array(F.get(F.array(*map(F.lit, ["aadhaar", "email", "person_name", "otp"])), (F.col("k") % 4).cast("int")))
    declared = F.array_distinct(F.transform(_signals(), lambda s: s["pii_type"]))
    found = let(declared, lambda d: F.filter(F.array(fields.conflicting(d, seen)), lambda _: F.size(d) > 0))
    return field_rows(spark, sf_dir).select("k", F.explode(found).alias("conflicting"))


@query(f"""
  WITH f AS ({FIELDS_SQL}) SELECT k, u.field, u.text, len(concat_ws(' ', nullif(name, ''), nullif(placeholder, ''), nullif(field_name, ''))) AS context FROM f,
  LATERAL (VALUES ('name', name), ('placeholder', placeholder), ('field_name', field_name)) AS u(field, text) WHERE u.text <> ''""")
def scannable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields unpivoted to their texts, with the context that detection reads beside them."""
    context = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "placeholder", "field_name")])
    return field_rows(spark, sf_dir).select(
        "k", F.length(context).cast("long").alias("context"), F.stack(F.lit(3), F.lit("name"), "name", F.lit("placeholder"), "placeholder", F.lit("field_name"), "field_name").alias("field", "text")
    ).where("text <> ''").select("k", "field", "text", "context")


# ---- known values --------------------------------------------------------------------------------
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values: whole benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.lit("person_name").alias("pii_type"), F.col("text").alias("value"), F.concat(F.lit("b"), F.col("item_id")).alias("slot"))


_KNOWN = "SELECT item_id, text AS value FROM benchmark"


@query(f"""
  SELECT d.doc_id, 'b' || b.item_id AS slot, strpos(lower(d.text), lower(b.value)) - 1 AS first_at FROM documents d JOIN ({_KNOWN}) b ON contains(lower(d.text), lower(b.value))
  WHERE regexp_matches(d.text, '(?i)' || CASE WHEN regexp_matches(b.value, '^[A-Za-z0-9_]') THEN '\\b' ELSE '' END || regexp_replace(b.value, '([.*+?^$' || '{{' || '}}' || '()|\\[\\]\\\\])', '\\\\\\1', 'g') || CASE WHEN regexp_matches(b.value, '[A-Za-z0-9_]$') THEN '\\b' ELSE '' END)""")
def known_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values found in documents: the first place of each pair."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = detect_text.known_matches(docs, passages(spark, sf_dir), "text", ["doc_id"])
    return found.groupBy("doc_id", "slot").agg(F.min("start").cast("long").alias("first_at"))


@query(f"SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM ({_KNOWN}) b WHERE contains(lower(d.text), lower(b.value)))")
def leaking_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold any known value: the gate before text leaves."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return detect_text.holding_known(docs, passages(spark, sf_dir), "text", ["doc_id"])


_PHRASE = """SELECT 'p' || item_id AS slot, value, '(?i)' || CASE WHEN regexp_matches(value, '^[A-Za-z0-9_]') THEN '\\b' ELSE '' END || regexp_escape(value)
    || CASE WHEN regexp_matches(value, '[A-Za-z0-9_]$') THEN '\\b' ELSE '' END AS rx
  FROM (SELECT item_id, array_to_string(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '')[2:3], ' ') AS value FROM benchmark)"""


@query(f"SELECT DISTINCT doc_id, slot FROM documents JOIN ({_PHRASE}) AS p ON length(value) >= 5 AND regexp_matches(text, rx)")
def known_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which short known values, accents and all: two words of each passage."""
    words = F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")
    known = table(spark, sf_dir, "benchmark").select(F.lit("person_name").alias("pii_type"), F.array_join(F.slice(words, 2, 2), " ").alias("value"), F.concat(F.lit("p"), F.col("item_id")).alias("slot"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return detect_text.known_pairs(docs, known, "text", ["doc_id"]).select("doc_id", "slot").distinct()


@query()
def separated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers found although the text has separators in other places (pattern by row)."""
    ids = id_candidates(spark, sf_dir, ("aadhaar", "card")).select("k", F.when(F.col("kind") == "card", "credit_card").otherwise("aadhaar").alias("pii_type"), "value")
    written = F.concat(F.lit("no. "), F.substring("value", 1, 4), F.lit(" "), F.substring("value", 5, 4), F.lit("-"), F.expr("substring(value, 9)"), F.lit("!"))
    # both types are looked for without boundaries; text and pattern are made once a row, and so are the hits
    sought = F.struct(written.alias("text"), detect_text.search_pattern(F.col("pii_type"), F.col("value")).alias("rx"))
    hits = let(sought, lambda s: detect_text.find_all(s["text"], s["rx"], alone=True))
    found = let(hits, lambda h: F.struct(F.size(h).alias("hits"), F.get(h, F.lit(0))["end"].alias("end")))
    return ids.select("k", "pii_type", F.inline(F.array(found)))


@query(f"SELECT pii_type, pii_type IN ({', '.join(sql(t) for t in SEPARATOR_INSENSITIVE)}) AS separators_ignored, count(*) AS entries FROM ({_ENTRY_SQL}) GROUP BY pii_type")
def separator_insensitive_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries by type, and whether the type's separators are cosmetic."""
    counts = entries(spark, sf_dir).groupBy("pii_type").agg(F.count("*").alias("entries"))
    return counts.withColumn("separators_ignored", F.col("pii_type").isin(list(SEPARATOR_INSENSITIVE)))


QUERIES, ORACLE = query.queries, query.oracle
