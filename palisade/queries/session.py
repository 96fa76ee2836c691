"""Queries over what a run keeps beside its page, on rows derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import session
from ..sources.derived import table
from ..taxonomy import POLICIES
from .fields import SIGNALS_SQL, _signals, field_rows
from .registry import Registry

query = Registry()

_in = lambda values, k: f"[{', '.join('NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][({k} % {len(values)} + 1)::INT]"


def _pick(values: list, k: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values)).cast("int"))


# ---- supplied values -----------------------------------------------------------------------------
ASKED = ["PHONE_HOME", "phone home", "OTP_1", "my password", "GIVEN_NAME_A", "EMAIL_X", "unknown thing", "otp-2"]
TYPES = [None, "phone", None, "password", None, None, None, "otp"]
ORIGINS = [None, "https://s1.example", "https://s2.example"]
_KINDS = sorted((p.pii_type for p in POLICIES), key=lambda t: (-len(t), t))
_kind_sql = lambda v: "CASE " + " ".join(f"WHEN starts_with({v}, '{t.upper()}') THEN '{t}'" for t in _KINDS) + " END"
SUPPLIED_SQL = f"""
  SELECT run, seq, requested, value, pii_type, origin, token, list_distinct([token, requested]) AS aliases FROM (
    SELECT *, CASE WHEN starts_with(requested, upper(pii_type)) AND regexp_matches(requested, '^[A-Z][A-Z0-9_]{{2,80}}$') THEN requested
           ELSE upper(pii_type) || '_LOCAL_' || upper(translate(substr(md5(run || '|' || seq || '|' || requested), 1, 10), '0123456789', 'ghijklmnop')) END AS token FROM (
      SELECT run, seq, requested, value, coalesce(given, {_kind_sql('requested')}, 'secret_token') AS pii_type, origin FROM (
        SELECT o_custkey AS run, o_orderkey AS seq, upper(trim({_in(ASKED, 'o_orderkey')})) AS requested, 'v' || o_orderkey AS value, {_in(TYPES, 'o_orderkey')} AS given, {_in(ORIGINS, 'o_orderkey // 8')} AS origin FROM orders)))"""


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), k.alias("seq"), _pick(ASKED, k).alias("requested"), F.concat(F.lit("v"), k).alias("value"), _pick(TYPES, k).alias("pii_type"), _pick(ORIGINS, F.floor(k / 8)).alias("origin"),
    )
    return session.supplied(rows)


@query(f"SELECT run, seq, pii_type, token, len(aliases)::INT AS aliases FROM ({SUPPLIED_SQL})")
def supplied_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a user gives during a run, with the tokens that stand for them."""
    return _supplied(spark, sf_dir).select("run", "seq", "pii_type", "token", F.size("aliases").alias("aliases"))


@query(f"SELECT run, token, arg_max(value, seq) AS value, lower(substr(token, len(arg_max(pii_type, seq)) + 2)) AS slot FROM ({SUPPLIED_SQL}) GROUP BY run, token")
def supplied_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each token, as known values to be erased."""
    return session.latest_supplied(_supplied(spark, sf_dir)).select("run", "token", "value", F.lower(F.expr("substring(token, length(pii_type) + 2)")).alias("slot"))


@query(f"""
  WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, token ORDER BY seq DESC) AS nth FROM ({SUPPLIED_SQL})) WHERE nth = 1),
  q AS (SELECT c_custkey AS k, c_custkey AS run, upper({_in(ASKED, 'c_custkey // 3')}) AS name, {_in(ORIGINS, 'c_custkey')} AS origin FROM customer),
  n AS (SELECT run, name, arg_max(token, seq) AS token, arg_max({{'o': origin}}, seq).o AS at FROM (SELECT run, unnest(aliases) AS name, token, origin, seq FROM e) GROUP BY run, name),
  t AS (SELECT q.k, count(*) AS n, min(e.token) AS token FROM q JOIN e ON e.run = q.run AND e.pii_type = {_kind_sql('q.name')} AND (e.origin IS NULL OR q.origin IS NULL OR e.origin = q.origin) GROUP BY q.k)
  SELECT q.k, CASE WHEN n.token IS NOT NULL THEN CASE WHEN n.at IS NULL OR q.origin IS NULL OR n.at = q.origin THEN n.token END WHEN t.n = 1 THEN t.token END AS token
  FROM q LEFT JOIN n ON n.run = q.run AND n.name = q.name LEFT JOIN t ON t.k = q.k""")
def answered_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied value that a handle means on a page: by name, else as the only one of its type."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("k"), k.alias("run"), _pick(ASKED, F.floor(k / 3)).alias("handle"), _pick(ORIGINS, k).alias("origin"))
    return session.found_supplied(asked, session.latest_supplied(_supplied(spark, sf_dir)))


@query("""
  WITH n AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'GIVEN_NAME_1' WHEN 1 THEN 'family_name_x' ELSE 'PHONE_1' END AS handle,
                    list_filter(regexp_split_to_array(trim(CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE replace(c_name, '#', '  ') || ' ' || c_mktsegment END), '\\s+'), lambda w: w <> '') AS w FROM customer)
  SELECT k, CASE k % 3 WHEN 0 THEN w[1] WHEN 1 THEN CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') END END AS part FROM n""")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given and family names of stored full names."""
    k = F.col("c_custkey")
    handle = F.when(k % 3 == 0, "GIVEN_NAME_1").when(k % 3 == 1, "family_name_x").otherwise("PHONE_1")
    full = F.when(k % 4 == 0, F.col("c_name")).otherwise(F.concat(F.replace("c_name", F.lit("#"), F.lit("  ")), F.lit(" "), F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select(k.alias("k"), session.name_part(handle, full).alias("part"))


# ---- offered and erased ----------------------------------------------------------------------------
SLOTS = ["main", "home", "work", "provider_key"]
_LIFETIME = "CASE pii_type " + " ".join(f"WHEN '{p.pii_type}' THEN '{p.lifetime}'" for p in POLICIES) + " END"
OFFERED_TYPES = ["phone", "email", "otp", "api_key", "pan"]


@query(f"""
  WITH e AS (SELECT *, {_LIFETIME} AS lifetime, upper(pii_type || '_' || slot) AS token FROM (
    SELECT s_suppkey AS seq, {_in(OFFERED_TYPES, 's_suppkey')} AS pii_type, {_in(SLOTS, 's_suppkey // 5')} AS slot, s_name AS value, CASE WHEN s_suppkey % 3 > 0 THEN 'https://n' || s_nationkey || '.example' END AS site FROM supplier)),
  o AS (SELECT DISTINCT 'https://n' || n_nationkey || '.example' AS origin FROM nation)
  SELECT origin, token, pii_type, length FROM (
    SELECT origin, token, pii_type, len(value)::INT AS length, row_number() OVER (PARTITION BY origin, token ORDER BY seq) AS nth FROM o JOIN e ON e.site IS NULL OR e.site = o.origin
    WHERE lifetime <> 'ephemeral' AND slot <> 'provider_key') WHERE nth = 1""")
def offered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By origin the stored values that its pages may be filled from."""
    k = F.col("s_suppkey")
    site = lambda n: F.concat(F.lit("https://n"), n, F.lit(".example"))
    kind = _pick(OFFERED_TYPES, k)
    entries = table(spark, sf_dir, "supplier").select(
        k.alias("seq"), kind.alias("pii_type"), _pick(SLOTS, F.floor(k / 5)).alias("slot"), F.col("s_name").alias("value"), F.when(k % 3 > 0, site(F.col("s_nationkey"))).alias("site"),
        session.named(kind, {p.pii_type: p.lifetime for p in POLICIES}, F.lit("")).alias("lifetime"),
    )
    return session.offered(entries, table(spark, sf_dir, "nation").select(site(F.col("n_nationkey")).alias("origin")))


#: (source, type, literal, token): source 0 edits, 1 findings, 2 stored values. One token holds a literal.
KNOWN = [
    (0, "person_name", "Asha Rao", "PERSON_NAME_SELF"), (2, "person_name", "Asha Rao", "PERSON_NAME_OTHER"), (2, "roll_number", "21CS042", "ROLL_NUMBER_21CS042"),
    (1, "person_name", "Asha Rao Verma", "PERSON_NAME_0"), (2, "aadhaar", "234567890124", "AADHAAR_MAIN"), (2, "otp", "12", "OTP_1"),
]
SAID = ["Asha Rao Verma, roll 21CS042", "asha rao has 2345 6789-0124", "token ROLL_NUMBER_21CS042 for ASHA RAO", "nothing of note", "Asha Raoul and 21cs-042"]
_SCRUBBED = "s"
for _rx, _to in (
    (r"2[\s\-/.()]?3[\s\-/.()]?4[\s\-/.()]?5[\s\-/.()]?6[\s\-/.()]?7[\s\-/.()]?8[\s\-/.()]?9[\s\-/.()]?0[\s\-/.()]?1[\s\-/.()]?2[\s\-/.()]?4", "AADHAAR_MAIN"),
    (r"2[\s\-/.()]?1[\s\-/.()]?C[\s\-/.()]?S[\s\-/.()]?0[\s\-/.()]?4[\s\-/.()]?2", "ROLL_NUMBER_0"),
    (r"\bAsha Rao Verma\b", "PERSON_NAME_0"), (r"\bAsha Rao\b", "PERSON_NAME_SELF"), (r"ROLL_NUMBER_21CS042", "ROLL_NUMBER_0"),
):
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_rx}', '{_to}', 'gi')"


@query(f"SELECT k, {_SCRUBBED} AS text FROM (SELECT o_orderkey AS k, {_in(SAID, 'o_orderkey')} || ' #' || o_orderkey AS s FROM orders)")
def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing texts without known literals: longest first, leaking tokens rewritten."""
    known = spark.createDataFrame([("g", s, i, t, x, token) for i, (s, t, x, token) in enumerate(KNOWN)], "grp string, source int, seq int, pii_type string, literal string, token string")
    k = F.col("o_orderkey")
    texts = table(spark, sf_dir, "orders").select(k.alias("k"), F.lit("g").alias("grp"), F.concat(_pick(SAID, k), F.lit(" #"), k).alias("s"))
    return texts.join(session.substitutions(known), "grp").select("k", session.scrubbed(F.col("s"), F.col("substitutions")).alias("text"))


# ---- pages -------------------------------------------------------------------------------------------
ROLES = ["img", "button", "textbox", "link", "figure", "generic", "heading"]
_EL = f"""SELECT l_orderkey AS page_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS ord, 'el_' || ord AS id, {_in(ROLES, 'l_partkey')} AS role, 'n' || l_suppkey AS name, l_discount > 0.08 AS hidden, l_tax < 0.06 AS in_viewport,
  l_partkey % 11 = 0 AS paints, (l_quantity * 3)::DOUBLE AS w, l_linenumber * 4.0 AS h, (l_partkey % 1500)::DOUBLE AS y, l_suppkey % 2 = 0 AS interactive, l_suppkey % 5 = 0 AS disabled,
  l_partkey % 3 = 0 AS invalid, l_partkey % 6 = 0 AS was_invalid FROM lineitem"""


#: A line item's place on its page, as good as unique.
_SEQ_SQL = "l_linenumber * 1000000000L + l_partkey * 10000 + l_suppkey"


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.expr(_SEQ_SQL).alias("ord"), F.concat(F.lit("el_"), F.expr(_SEQ_SQL)).alias("id"), _pick(ROLES, p).alias("role"), F.concat(F.lit("n"), s).alias("name"),
        (F.col("l_discount") > 0.08).alias("hidden"), (F.col("l_tax") < 0.06).alias("in_viewport"), (p % 11 == 0).alias("paints"), (F.col("l_quantity") * 3).alias("w"), (F.col("l_linenumber") * 4.0).alias("h"),
        (p % 1500).cast("double").alias("y"), (s % 2 == 0).alias("interactive"), (s % 5 == 0).alias("disabled"), (p % 3 == 0).alias("invalid"), (p % 6 == 0).alias("was_invalid"),
    )


_SURFACE = "NOT hidden AND in_viewport AND (paints OR role IN ('img', 'figure')) AND w >= 16 AND h >= 10"


@query(f"""SELECT page_id, count(*) FILTER ({_SURFACE}) AS surfaces, count(*) FILTER ({_SURFACE}) > 0 OR count(*) >= 1500 AS needs_reading, count(*) FILTER (interactive AND NOT disabled AND NOT hidden) AS actionable,
  round(50 + greatest(800, max(y + h)))::BIGINT AS page_height, max(y + h) > 804 AS more_below FROM ({_EL}) GROUP BY page_id""")
def page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By page: pictures that could hide text, whether to read them, what can be acted on, its extent."""
    own = session.is_surface(*[F.col(c) for c in ("hidden", "in_viewport", "paints", "role", "w", "h")])
    bottom = F.max(F.col("y") + F.col("h"))
    return _elements(spark, sf_dir).groupBy("page_id").agg(
        F.count_if(own).alias("surfaces"), ((F.count_if(own) > 0) | (F.count("*") >= session.NODE_CAP)).alias("needs_reading"),
        F.count_if(F.col("interactive") & ~F.col("disabled") & ~F.col("hidden")).alias("actionable"),
        F.floor(50 + F.greatest(F.lit(800.0), bottom) + 0.5).alias("page_height"), (bottom > 804).alias("more_below"),
    )


@query(f"SELECT page_id, count(*) AS n, md5(string_agg(id || '|' || role || '|' || name, chr(10) ORDER BY ord)) AS shape FROM ({_EL}) GROUP BY page_id")
def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By page a number that changes when its elements do."""
    return session.shape(_elements(spark, sf_dir))


@query(f"SELECT page_id, id FROM ({_EL}) WHERE invalid AND NOT was_invalid")
def fresh_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a page refuses now and did not before."""
    rows = _elements(spark, sf_dir)
    return rows.where("invalid").select("page_id", "id").join(rows.where("was_invalid").select("page_id", "id"), ["page_id", "id"], "left_anti")


@query(f"""
  WITH f AS (SELECT page_id, role, list(name ORDER BY ord) AS names FROM ({_EL}) GROUP BY page_id, role)
  SELECT page_id, role, role || ': ' || array_to_string(names[1:2], '; ') || CASE WHEN len(names) > 2 THEN ' …and ' || (len(names) - 2) || ' more' ELSE '' END AS line FROM f""")
def bucket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each group in a line of two, and how many more there are."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    return _elements(spark, sf_dir).groupBy("page_id", "role").agg(names.alias("names")).select("page_id", "role", session.bucket_line(F.col("role"), F.col("names"), 2).alias("line"))


@query(f"""SELECT page_id, ord, floor(y * 1.25)::BIGINT AS y, ceil(w * 1.25)::BIGINT AS w, ceil(h * 1.25)::BIGINT AS h FROM ({_EL})""")
def covering_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles in pixels that cover scaled ones."""
    r = session.scaled_out(F.lit(0.0), F.col("y"), F.col("w"), F.col("h"), F.lit(1.25))
    return _elements(spark, sf_dir).select("page_id", "ord", r.alias("r")).select("page_id", "ord", "r.y", "r.w", "r.h")


# ---- findings -------------------------------------------------------------------------------------------
FOUND_TYPES, MODES = ["phone", "person_name", "credit_card"], ["mask_solid", "none", "placeholder", "other"]
DETECTORS = [["pattern"], ["semantic", "known_value"], ["structural", "pattern"], []]
_FIND = f"""SELECT l_orderkey AS grp, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, {_in(FOUND_TYPES, 'l_partkey')} AS pii_type, {_in(MODES, 'l_suppkey')} AS redaction, [['pattern'], ['semantic', 'known_value'], ['structural', 'pattern'], []][(l_partkey % 4 + 1)::INT] AS detectors,
  l_tax * 10 AS confidence FROM lineitem"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    lists = F.array(*[F.array(*map(F.lit, d)).cast("array<string>") for d in DETECTORS])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("grp"), F.expr(_SEQ_SQL).alias("seq"), _pick(FOUND_TYPES, p).alias("pii_type"), _pick(MODES, F.col("l_suppkey")).alias("redaction"),
        F.get(lists, (p % 4).cast("int")).alias("detectors"), (F.col("l_tax") * 10).alias("confidence"),
    )


_cases = lambda of, values: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {of} END"


@query(f"""
  WITH f AS (SELECT *, CASE WHEN list_contains(detectors, 'known_value') THEN 'known_value' ELSE coalesce(detectors[1], 'unknown') END AS evidence FROM ({_FIND}) WHERE redaction <> 'none'),
  g AS (SELECT grp, pii_type, redaction, count(*) AS n, arg_min(evidence, seq) AS evidence, min(seq) AS first FROM f GROUP BY ALL)
  SELECT grp, replace(pii_type, '_', ' ') AS what, {_cases('redaction', session.HIDDEN_AS)} AS how, {_cases('evidence', session.FOUND_BY)} AS found_by, n, row_number() OVER (PARTITION BY grp ORDER BY first)::INT AS place FROM g""")
def described_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was hidden on a page, in words, without saying what it was."""
    return session.described(_findings(spark, sf_dir))


@query(f"""
  SELECT 1 AS by_what, d AS name, count(*) AS n FROM (SELECT unnest(CASE WHEN len(detectors) = 0 THEN ['unknown'] ELSE detectors END) AS d FROM ({_FIND})) GROUP BY d
  UNION ALL SELECT 2, pii_type, count(*) FROM ({_FIND}) GROUP BY pii_type""")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by detector, and findings by type (a finding of two detectors is one): one pass, each
    finding as rows (kind, name) that are summed where they are."""
    detectors = F.when(F.size("detectors") == 0, F.array(F.lit("unknown"))).otherwise(F.col("detectors"))
    names = F.concat(F.transform(detectors, lambda d: F.struct(F.lit(1).alias("by_what"), d.alias("name"))), F.array(F.struct(F.lit(2).alias("by_what"), F.col("pii_type").alias("name"))))
    return _findings(spark, sf_dir).select(F.inline(names)).groupBy("by_what", "name").agg(F.count("*").alias("n"))


@query(f"SELECT grp, seq, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, seq)::INT AS place FROM ({_FIND})")
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's findings, the surest first."""
    from pyspark.sql import Window

    return _findings(spark, sf_dir).select("grp", "seq", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("confidence"), "seq")).alias("place"))


# ---- words, labels, replies ---------------------------------------------------------------------------------
LABELS = ["a Face of someone", "Signature box", "text input", "search button", "dropdown list", "checkbox", "photograph", "hyperlink", "button", "a person", "logo"]


@query(f"""SELECT p_partkey AS k, CASE {" ".join(f"WHEN contains(l, '{a}') THEN '{b}'" for a, b in session.LABEL_ROLES.items())} ELSE 'generic' END AS role,
  CASE {" ".join(f"WHEN contains(l, '{a}') THEN '{b}'" for a, b in session.LABEL_TYPES.items())} END AS pii_type FROM (SELECT p_partkey, lower({_in(LABELS, 'p_partkey')}) AS l FROM part)""")
def visual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and sensitive types of what a detector of pictures calls a region."""
    k, label = F.col("p_partkey"), _pick(LABELS, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select(k.alias("k"), session.by_content(label, session.LABEL_ROLES, "generic").alias("role"), session.by_content(label, session.LABEL_TYPES, None).alias("pii_type"))


CLICKS = ["Download result", "Save", "admit  card", "PDF", "Saved items", "Next", "export all", "Hall ticket 2024"]


@query(f"SELECT event_id, event_type = 'view' OR event_type = 'click' AND regexp_matches({_in(CLICKS, 'event_id')}, '(?i)\\b(?:download|save|export|admit\\s*card|hall\\s*ticket|pdf)\\b') AS may FROM events")
def download_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that may start a download: clicks at a point, and clicks on a label that says so."""
    label = _pick(CLICKS, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", ((F.col("event_type") == "view") | (F.col("event_type") == "click") & label.rlike("(?i)" + session.DOWNLOAD_LABEL)).alias("may"))


VALUES = ['"plain"', '{"kind":"literal","text":"a b"}', '{"kind":"literal"}', '{"kind":"placeholder","placeholderId":"OTP_1"}', '{"kind":"placeholder","placeholder_id":"PAN_2"}', '{"kind":"placeholder"}',
          '{"text":"short"}', '{"placeholderId":"CVV_1"}', "[1]", "{}"]
REFS = [("literal", "plain"), ("literal", "a b"), ("failed", "text"), ("placeholder", "OTP_1"), ("placeholder", "PAN_2"), ("failed", "placeholderId"), ("literal", "short"), ("placeholder", "CVV_1"),
        ("failed", "string or object"), ("failed", "kind")]
ASKS = ["OTP", "security answer", "Missing-Profile Field", "captcha", "something", " confirmation "]


@query(f"""SELECT event_id, {_in([a for a, _ in REFS], 'event_id')} AS kind, {_in([b for _, b in REFS], 'event_id')} AS text,
  CASE WHEN c IN ({", ".join(f"'{x}'" for x in session.CATEGORIES)}) THEN c ELSE 'other' END AS category FROM (SELECT event_id, regexp_replace(lower(trim({_in(ASKS, 'event_id')})), '[\\s-]', '_', 'g') AS c FROM events)""")
def reply_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and categories of input in replies, shorthand included (the SQL states the values)."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", session.value_ref(_pick(VALUES, k)).alias("r"), session.category(_pick(ASKS, k)).alias("category")).select("event_id", "r.kind", "r.text", "category")


@query("""
  WITH r AS (SELECT user_id AS run, event_id AS step, event_type IN ('view', 'purchase') AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY run ORDER BY step) AS island FROM r),
  n AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY step) AS nth FROM g WHERE NOT ok) SELECT run, min(step) AS failed_at FROM n WHERE nth = 4 GROUP BY run""")
def bad_reply_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a run ends because too many unusable replies followed one another."""
    return session.bad_reply_ends(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").isin("view", "purchase").alias("ok")))


@query("""
  WITH w AS (SELECT o_orderkey AS k, 1000 AS at_ms FROM orders),
  e AS (SELECT l_orderkey AS k, l_linenumber AS id, unnest([{'kind': 'created', 'ms': (l_partkey % 50) * 100}, {'kind': CASE WHEN l_suppkey % 4 = 0 THEN 'interrupted' ELSE 'complete' END, 'ms': (l_partkey % 50) * 100 + (l_suppkey % 70) * 1000 - 500}], recursive := true) FROM lineitem),
  i AS (SELECT *, min(ms) FILTER (kind = 'created') OVER (PARTITION BY k, id) AS began FROM e),
  f AS (SELECT w.k, at_ms, min(began) AS began, min(ms) FILTER (kind = 'complete' AND ms >= began) AS done, min(ms) FILTER (kind = 'interrupted' AND ms >= began) AS lost FROM w LEFT JOIN i USING (k) GROUP BY w.k, at_ms),
  s AS (SELECT *, greatest(began, at_ms) AS start FROM f)
  SELECT k, CASE WHEN began IS NULL OR began >= at_ms + 3000 THEN 'none' WHEN done < start + 60000 AND (lost IS NULL OR greatest(done, start) <= greatest(lost, start)) THEN 'complete' ELSE 'failed' END AS outcome FROM s""")
def download_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for a download end with."""
    waits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1000).alias("at_ms"))
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    ended = F.struct(F.when(s % 4 == 0, "interrupted").otherwise("complete").alias("kind"), ((p % 50) * 100 + (s % 70) * 1000 - 500).alias("at_ms"))
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.inline(F.array(F.struct(F.lit("created").alias("kind"), ((p % 50) * 100).alias("at_ms")), ended)))
    return session.download_outcomes(waits, events)


# ---- small decisions ---------------------------------------------------------------------------------------------
REJECT = [("phone", "Mobile", " "), ("roll_number", "Roll", "Roll Number"), ("email", "My E-Mail", "my email"), ("pan", "", "ABCPX1234L"), ("otp", "code", "123")]


@query(f"""SELECT c_custkey AS k, {_in(["empty", "type_name", "label", None, None], 'c_custkey')} AS problem FROM customer""")
def rejected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an entry isn't stored (the SQL states the outcome of each case)."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), session.rejection(*[_pick([r[i] for r in REJECT], k) for i in range(3)]).alias("problem"))


@query("""SELECT s_suppkey AS k, CASE WHEN ram IS NULL THEN CASE WHEN mb > 700 THEN 'tight' ELSE 'comfortable' END WHEN mb > ram * 512 THEN 'over-budget' WHEN mb > ram * 512 * 0.6 THEN 'tight' ELSE 'comfortable' END AS fit,
  CASE WHEN s_suppkey % 2 = 0 THEN 'webgpu' ELSE 'wasm' END AS backend, (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AND s_suppkey % 5 > 0 AS able
  FROM (SELECT s_suppkey, (s_suppkey * 37) % 3000 AS mb, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 7)::DOUBLE END AS ram FROM supplier)""")
def model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether models fit a machine, what runs them, and whether it can run them at all."""
    k = F.col("s_suppkey")
    gpu = k % 2 == 0
    return table(spark, sf_dir, "supplier").select(
        k.alias("k"), session.fit(k * 37 % 3000, F.when(k % 7 > 0, (k % 7).cast("double"))).alias("fit"), F.when(gpu, "webgpu").otherwise("wasm").alias("backend"), ((gpu | (k % 3 == 0)) & (k % 5 > 0)).alias("able"),
    )


BASES = ["https://Api.Example.com:8443/v1//", "http://localhost:11434", "nothing", "https://u:p@h.example/x?y"]
PATTERNS = ["https://api.example.com:8443/*", "http://localhost:11434/*", None, "https://h.example/*"]
JOINED = ["https://Api.Example.com:8443/v1/models", "http://localhost:11434/models", "nothing/models", "https://u:p@h.example/x?y/models"]


@query(f"SELECT n_nationkey AS k, {_in(PATTERNS, 'n_nationkey')} AS pattern, {_in(JOINED, 'n_nationkey')} AS url FROM nation")
def service_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permissions and addresses of services (the SQL states the outcome of each case)."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("k"), session.host_pattern(_pick(BASES, k)).alias("pattern"), session.joined_url(_pick(BASES, k), F.lit("/models")).alias("url"))


@query("""SELECT k, CASE WHEN len(w) = 1 THEN 1 ELSE 2 END AS n, array_to_string(w, '') AS closed, CASE WHEN len(p) > 12 THEN substr(p, 1, 12) || '…' ELSE p END AS clipped
  FROM (SELECT p_partkey AS k, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS w, p_name AS p FROM part)""")
def line_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a recognised line that are searched, and its name as shown."""
    v = session.line_variants(F.filter(F.split("p_name", " "), lambda x: x != ""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.size(v).alias("n"), F.element_at(v, -1).alias("closed"), session.clipped(F.col("p_name"), 12).alias("clipped"))


@query(f"""
  SELECT k, arg_min(pii_type, (-confidence, CASE evidence WHEN 'input' THEN 0 WHEN 'autocomplete' THEN 1 ELSE 2 END)) AS pii_type
  FROM ({SIGNALS_SQL}) WHERE confidence >= 0.5 GROUP BY k""")
def wanted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each field asks for, by its strongest signal."""
    # a condition on the type would be pushed before its projection, and the signals found twice
    return field_rows(spark, sf_dir).select("k", F.explode(F.array_compact(F.array(session.strongest(_signals())))).alias("pii_type"))


QUERIES, ORACLE = query.queries, query.oracle
