"""Queries over text: checks of identifiers, spans by rule, labelled values, sanitising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksum
from ..functions.dialect import re2, sql
from ..operators import detect_text
from ..sources.derived import ID_CANDIDATES_SQL, LABELLED_SQL, id_candidates, labelled_texts, spread, table
from ..taxonomy import (
    CONTEXT_WINDOW,
    CREDENTIAL_STOP_WORDS,
    LABELLED_VALUES,
    PATTERN_RULES,
    POLICIES,
    VERHOEFF_PLACE,
    VERHOEFF_PRODUCT,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# ---- SQL for the checks, over a value v -------------------------------------------------------
_SPACES = re2(r"[\s-]")


def _norm(v: str) -> str:
    return f"regexp_replace({v}, {sql(_SPACES)}, '', 'g')"


def _verhoeff(d: str) -> str:
    place, product = "".join(VERHOEFF_PLACE), "".join(VERHOEFF_PRODUCT)
    digit = f"substr({d}, len({d}) - i::INT, 1)::INT"
    placed = f"substr('{place}', ((i % 8) * 10 + {digit} + 1)::INT, 1)::INT"
    return f"(list_reduce(list_prepend(0, list_transform(range(len({d})), lambda i: {placed})), lambda a, p: substr('{product}', (a * 10 + p + 1)::INT, 1)::INT) = 0)"


def _luhn(d: str) -> str:
    digit = f"substr({d}, len({d}) - i::INT, 1)::INT"
    return f"(list_sum(list_transform(range(len({d})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"


def _entropy(v: str) -> str:
    share = f"((len({v}) - len(replace({v}, c, ''))) / len({v})::DOUBLE)"
    return f"(- list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: {share} * log2({share}))))"


_PAN = r"^[A-Z]{3}[PCHFATBLJG][A-Z][0-9]{4}[A-Z]$"


def check_sql(name: str, v: str) -> str:
    n, u = _norm(v), f"upper(trim({v}))"
    m = lambda x, rx: f"regexp_matches({x}, '{rx}')"
    return {
        "aadhaar": f"CASE WHEN {m(n, '^[2-9][0-9]{11}$')} THEN {_verhoeff(n)} ELSE false END",
        "payment_card": f"CASE WHEN {m(n, '^[0-9]{13,19}$')} THEN {_luhn(n)} ELSE false END",
        "pan": m(u, _PAN),
        "ifsc": m(u, "^[A-Z]{4}0[A-Z0-9]{6}$"),
        "indian_mobile": m(f"regexp_replace({n}, '^\\+?91', '')", "^[6-9][0-9]{9}$"),
        "passport": m(u, "^[A-PR-WY][1-9][0-9]{6}$"),
        "gstin": f"CASE WHEN {m(u, '^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[A-Z0-9]$')} THEN substr({u}, 1, 2)::INT BETWEEN 1 AND 38 AND {m(f'substr({u}, 3, 10)', _PAN)} ELSE false END",
        "vehicle_number": m(f"upper({n})", "^[A-Z]{2}[0-9]{1,2}[A-Z]{0,3}[0-9]{4}$"),
        "portal_identifier": m(v, "[0-9]"),
        "contextual_secret": (
            f"CASE WHEN len(trim({v})) BETWEEN 16 AND 512 AND NOT {m(f'trim({v})', '(?i)^(?:[A-Z]+_)*(?:LOCAL|HIDDEN)(?:_[A-Z]+)*$')}"
            f" AND NOT {m(f'trim({v})', '(?i)^(?:https?://|www[.])')} AND NOT {m(f'trim({v})', '(?i)[.](?:js|css|png|jpe?g|svg|webp|woff2?)(?:[?]|$)')}"
            f" AND {m(f'trim({v})', '[a-z]')}::INT + {m(f'trim({v})', '[A-Z]')}::INT + {m(f'trim({v})', '[0-9]')}::INT + {m(f'trim({v})', '[^A-Za-z0-9]')}::INT >= 2"
            f" THEN {_entropy(f'trim({v})')} >= 3.2 ELSE false END"
        ),
    }[name]


_CHECKS = {
    "aadhaar": "aadhaar", "card": "payment_card", "pan": "pan", "ifsc": "ifsc", "mobile": "indian_mobile", "passport": "passport", "gstin": "gstin",
    "vehicle": "vehicle_number", "secret": "contextual_secret",
}


@query("SELECT k, kind, CASE kind " + " ".join(f"WHEN '{k}' THEN {check_sql(c, 'value')}" for k, c in _CHECKS.items())
       + f" END AS valid, round({_entropy('value')}, 6) AS entropy FROM ({ID_CANDIDATES_SQL})")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check on every derived identifier of its kind."""
    rows = id_candidates(spark, sf_dir)
    valid = F.lit(False)
    for kind, name in _CHECKS.items():
        valid = F.when(F.col("kind") == kind, checksum.VALIDATORS[name](F.col("value"))).otherwise(valid)
    return rows.select("k", "kind", F.coalesce(valid, F.lit(False)).alias("valid"), F.round(checksum.entropy(F.col("value")), 6).alias("entropy"))


# ---- SQL for spans ------------------------------------------------------------------------------
def find_all_sql(rx: str, source: str, group: int = 0) -> str:
    """Rows (k, text, start, "end", value) of all matches over source(k, text)."""
    lit = sql(rx)
    value = f"regexp_extract_all(text, {lit}, {group})"
    shift = "0" if not group else "len(hit) - len(value) - (instr(reverse(hit), reverse(value)) - 1)"
    return f"""
      SELECT k, text, begin + {shift} AS start, begin + {shift} + len(value) AS "end", value FROM (
        SELECT k, text, hits[i] AS hit, vals[i] AS value,
               list_sum(list_transform(parts[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x)))::BIGINT, 0) AS begin
        FROM (SELECT k, text, parts, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
          SELECT k, text, string_split_regex(text, {lit}) AS parts, regexp_extract_all(text, {lit}) AS hits, {value} AS vals FROM ({source}) WHERE regexp_matches(text, {lit}))))"""


def pattern_ctes(source: str) -> str:
    """CTEs m0.. (matches of each rule) and a0.. (accepted so far): the last is ``accepted``."""
    out = [f"src AS MATERIALIZED ({source})"]
    for i, r in enumerate(PATTERN_RULES):
        near = re2(r.context, True) if r.context else ""
        where = [check_sql(r.validator, "value")] if r.validator else []
        if near:
            where.append(f"regexp_matches(substr(text, greatest(start - {CONTEXT_WINDOW}, 0) + 1, \"end\" + {CONTEXT_WINDOW} - greatest(start - {CONTEXT_WINDOW}, 0)), {sql(near)})")
        src = f"SELECT k, text FROM src WHERE regexp_matches(text, {sql(near)})" if near else "SELECT k, text FROM src"
        out.append(f"m{i} AS MATERIALIZED (SELECT k, start, \"end\", '{r.pii_type}' AS pii_type, {r.confidence}::DOUBLE AS confidence, {i} AS rule FROM ({find_all_sql(re2(r.pattern, r.ignore_case), src)})"
                   + (f" WHERE {' AND '.join(where)}" if where else "") + ")")
        if i == 0:
            out.append("a0 AS MATERIALIZED (SELECT * FROM m0)")
        else:
            out.append(f"a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT * FROM m{i} n WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} p WHERE p.k = n.k AND p.start < n.\"end\" AND n.start < p.\"end\"))")
    out.append(f"accepted AS (SELECT * FROM a{len(PATTERN_RULES) - 1})")
    return ", ".join(out)


_TEXTS_SQL = "SELECT doc_id AS k, text FROM documents UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, text FROM conversations"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text")
    turns = table(spark, sf_dir, "conversations").select((1000000000 + F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return spread(docs).unionByName(spread(turns))


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select("k", F.inline(detect_text.find_patterns(F.col("text")))).select(
        "k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "pii_type", "confidence", "rule"
    )


@query("WITH " + pattern_ctes(_TEXTS_SQL) + ' SELECT k, start, "end", pii_type, confidence, rule FROM accepted')
def pattern_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over documents and conversations, one row a match."""
    return _spans(texts(spark, sf_dir))


@query("WITH " + pattern_ctes(LABELLED_SQL) + ' SELECT k, start, "end", pii_type, confidence, rule FROM accepted')
def pattern_spans_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over sentences with derived identifiers, labelled and not."""
    return _spans(labelled_texts(spark, sf_dir))


_POLICY_SQL = "(VALUES " + ", ".join(f"('{p.pii_type}', '{p.lifetime}', '{p.redaction}', {p.threshold}::DOUBLE, {str(p.never_blur).lower()}, {str(p.confirm).lower()})" for p in POLICIES) + ") AS p(pii_type, lifetime, redaction, threshold, never_blur, confirm)"


def policies(spark: SparkSession) -> DataFrame:
    """The policy table: 27 rows, so joins broadcast it."""
    return spark.createDataFrame([tuple(p) for p in POLICIES], "pii_type string, lifetime string, redaction string, threshold double, never_blur boolean, confirm boolean")


@query("WITH " + pattern_ctes("SELECT doc_id AS k, text FROM documents") + f"""
  SELECT d.lang, a.pii_type, p.redaction, count(*) AS n, count(DISTINCT a.k) AS documents, sum(a."end" - a.start)::BIGINT AS characters
  FROM accepted a JOIN documents d ON d.doc_id = a.k JOIN {_POLICY_SQL} USING (pii_type) WHERE a.confidence >= p.threshold GROUP BY ALL""")
def findings_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans at or above their type's threshold, counted by language and type."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    found = docs.select("doc_id", "lang", F.inline(detect_text.find_patterns(F.col("text"))))
    return found.join(F.broadcast(policies(spark)), "pii_type").where("confidence >= threshold").groupBy("lang", "pii_type", "redaction").agg(
        F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.sum(F.col("end") - F.col("start")).alias("characters")
    )


_RULES_SQL = "(VALUES " + ", ".join(f"('{r.pii_type}', {i}, {r.confidence}::DOUBLE, {str(bool(r.context)).lower()})" for i, r in enumerate(PATTERN_RULES)) + ") AS t(pii_type, rule, confidence, needs_context)"


@query("WITH " + pattern_ctes(_TEXTS_SQL) + f", n AS (SELECT rule, count(*) AS matches FROM accepted GROUP BY rule) SELECT pii_type, t.rule, confidence, needs_context, coalesce(matches, 0) AS matches FROM {_RULES_SQL} LEFT JOIN n ON n.rule = t.rule")
def pattern_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule, and how many matches it has in documents and conversations."""
    rules = spark.createDataFrame([(r.pii_type, i, r.confidence, bool(r.context)) for i, r in enumerate(PATTERN_RULES)], "pii_type string, rule int, confidence double, needs_context boolean")
    counts = _spans(texts(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("matches"))
    return rules.join(counts, "rule", "left").select("pii_type", "rule", "confidence", "needs_context", F.coalesce("matches", F.lit(0)).alias("matches"))


# ---- labelled values -----------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in CREDENTIAL_STOP_WORDS)
_CREDENTIAL = f"len(value) >= 6 AND lower(value) NOT IN ({_STOP}) AND (regexp_matches(value, '[0-9]') OR len(value) >= 12 OR regexp_matches(value, '[^A-Za-z0-9]'))"


def labelled_sql(source: str) -> str:
    """The rules that need no lookahead."""
    return " UNION ALL ".join(
        f"SELECT k, start, \"end\", '{t}' AS pii_type FROM ({find_all_sql(re2(rx, True), source, 1)}) WHERE value <> ''" + (f" AND {_CREDENTIAL}" if checked else "")
        for t, rx, checked in LABELLED_VALUES if "(?=" not in rx
    )


@query(labelled_sql(f"{_TEXTS_SQL} UNION ALL SELECT -k, text FROM ({LABELLED_SQL})"))
def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values after a label; the two rules that end at a lookahead have a query of their own."""
    rows = texts(spark, sf_dir).unionByName(labelled_texts(spark, sf_dir).withColumn("k", -F.col("k")))
    plain = [r for r in LABELLED_VALUES if "(?=" not in r[1]]
    found = rows.select("k", F.inline(detect_text.labelled_matches(F.col("text"), plain)))
    return found.select("k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "pii_type")


@query()
def labelled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and addresses after a label, up to a joining word (lookahead: not for SQL)."""
    own = [r for r in LABELLED_VALUES if "(?=" in r[1]]
    c = table(spark, sf_dir, "customer")
    said = F.concat(F.lit("Hello, my name is "), F.initcap(F.translate("c_name", "#0123456789", "abcdefghijk")), F.lit(" and my address: "), F.col("c_custkey"), F.lit(" Hill Road; thanks"))
    return c.select(F.col("c_custkey").alias("k"), said.alias("text")).select("k", F.inline(detect_text.labelled_matches(F.col("text"), own))).select(
        "k", "start", "end", "pii_type", "text"
    )


_URL = re2(r"https?://[^\s\"'<>]+", True)


@query(f"""
  WITH u AS ({find_all_sql(_URL, LABELLED_SQL)}), s AS (
    SELECT k, text, start, "end", lower(regexp_extract(value, '(?i)^(https?)://', 1)) AS scheme,
           lower(regexp_extract(value, '(?i)^https?://(?:[^/?#\\\\]*@)?([^/?#\\\\:@]+)', 1)) AS host, regexp_extract(value, '(?i)^https?://(?:[^/?#\\\\]*@)?[^/?#\\\\:@]+:([0-9]+)', 1) AS port FROM u)
  SELECT k, substr(text, 1, start) || CASE WHEN host = '' THEN '<HIDDEN_URL>' ELSE scheme || '://' || host || CASE WHEN port = '' THEN '' ELSE ':' || port END END || substr(text, "end" + 1) AS text FROM s""")
def sanitized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in free text cut to their origins."""
    return labelled_texts(spark, sf_dir).select("k", detect_text.sanitize_urls(F.col("text")).alias("text"))


@query()
def sanitized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, turns and derived sentences with sensitive spans hidden."""
    rows = texts(spark, sf_dir).unionByName(labelled_texts(spark, sf_dir).withColumn("k", -F.col("k")))
    return rows.select("k", detect_text.sanitized(F.col("text")).alias("text"), F.length("text").alias("was"))
