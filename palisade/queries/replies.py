"""Queries over replies, plans and proposed actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replies, validate
from ..sources.derived import table
from .registry import Registry

query = Registry()

#: Replies by event id: (text with {t} for the target and {n} for the id, parses, action, actions, error).
KINDS = [
    ('Sure.\n```json\n{{"reasoning": "x", "action": {{"type": "click", "target": "el_{t}"}}}}\n```', True, "click", 1, None),
    ('{{"actions": [{{"type": "fill", "target": "el_{t}", "value": "a"}}, {{"type": "press", "keys": "Enter"}}]}}', True, "type", 2, None),
    ('{{"action": {{"type": "click", "target": "el_{t}"}}', True, "click", 1, None),
    ('[{{"type": "goto", "url": "https://a.example/{n}"}}]', True, "goto_url", 1, None),
    ('{{"type": "Type-Text", "element_id": "el_{t}", "text": "q {{}} ]"}}', True, "type", 1, None),
    ('I cannot do that for {n}.', False, None, 0, "no_json"),
    ('{{"action": {{"type": "dance", "target": "el_{t}"}}}}', False, None, 0, "unknown_type"),
    ('{{"actions": []}}', False, None, 0, "empty"),
    ('{{"action": {{"type": "click"}}}}', False, None, 0, "no_target"),
    ('{{"steps": [{{"type": "wait"}}, {{"type": "done", "answer": "{n}"}}]}}', True, "noop", 2, None),
    ('{{"action": {{"type": "goto_url", "url": " "}}}}', False, None, 0, "no_url"),
    ('{{"actions": [' + ", ".join(['{{"type": "noop"}}'] * 11) + "]}}", True, "noop", 8, None),
    ('{{"type": "click_point", "point": {{"x": {n}, "y": 4}}}} trailing }} text', True, "click_point", 1, None),
    ('{{"type": "scroll", "note": "cut off in a str', True, "scroll", 1, None),
]


def _reply():
    parts = [F.replace(F.replace(F.lit(text.format(t="<t>", n="<n>")), F.lit("<t>"), (F.col("event_id") % 20).cast("string")), F.lit("<n>"), F.col("event_id").cast("string")) for text, *_ in KINDS]
    return F.get(F.array(*parts), (F.col("event_id") % len(KINDS)).cast("int"))


_q = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, (bool, int)) else f"'{v}'"


@query("SELECT event_id, e.ok, e.action, e.n_actions, e.error FROM events JOIN (VALUES " + ", ".join(f"({i}, {_q(ok)}, {_q(a)}, {n}, {_q(err)})" for i, (_, ok, a, n, err) in enumerate(KINDS))
       + f") AS e(kind, ok, action, n_actions, error) ON event_id % {len(KINDS)} = e.kind")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of known kinds parsed: whether, what first, how many, why not."""
    rows = table(spark, sf_dir, "events").select("event_id", _reply().alias("reply"))
    return replies.actions(rows).select("event_id", "ok", "action", "n_actions", "error")


@query("""SELECT event_id, substr('goal ' || repeat('g', (event_id % 400)::INT), 1, 300) AS goal, least(event_id % 9, 6)::INT AS n_steps,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'site' || event_id ELSE NULL END AS site FROM events""")
def parsed_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner replies normalised: lengths, number of steps, absent sites."""
    k = F.col("event_id")
    steps = F.array_join(F.transform(F.filter(F.sequence(F.lit(0).cast("long"), k % 9), lambda i: i < k % 9), lambda i: F.concat(F.lit('"step '), i, F.lit('"'))), ", ")
    site = F.when(k % 3 == 0, "null").when(k % 3 == 1, F.concat(F.lit("site"), k)).otherwise("")
    text = F.concat(F.lit('Plan:\n```json\n{"goal": "goal '), F.repeat(F.lit("g"), (k % 400).cast("int")), F.lit('", "steps": ['), steps, F.lit('], "site": "'), site, F.lit('"}\n``` ok'))
    p = replies.plan_of(F.col("text"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", p["goal"].alias("goal"), F.size(p["steps"]).alias("n_steps"), p["site"].alias("site"))


# ---- proposed actions against a page and a store of values ------------------------------------------
ACTIONS_SQL = """
  SELECT event_id, user_id AS run, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'type' WHEN 'signup' THEN 'goto_url' ELSE 'noop' END AS type,
         event_id % 20 AS target, CASE WHEN event_id % 3 = 0 THEN 'literal' ELSE 'placeholder' END AS value_kind,
         ['PHONE_MAIN', 'PASSWORD_SITE1', 'AADHAAR_X', 'PASSWORD_B', 'OTP_Z', 'NOPE'][(event_id % 6 + 1)::INT] AS handle,
         ['https://a.example/', 'javascript:x', 'not an address', 'file:///etc'][(event_id % 4 + 1)::INT] AS url, 'https://s' || event_id % 3 || '.example' AS origin FROM events"""


def proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "scroll").when(F.col("event_type") == "purchase", "type").when(F.col("event_type") == "signup", "goto_url").otherwise("noop")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("run"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), kind.alias("type"), (k % 20).alias("target"),
        F.when(k % 3 == 0, "literal").otherwise("placeholder").alias("value_kind"), pick("PHONE_MAIN", "PASSWORD_SITE1", "AADHAAR_X", "PASSWORD_B", "OTP_Z", "NOPE").alias("handle"),
        pick("https://a.example/", "javascript:x", "not an address", "file:///etc").alias("url"), F.concat(F.lit("https://s"), k % 3, F.lit(".example")).alias("origin"),
    )


_KINDS = ["click", "scroll", "type", "goto_url", "noop", "key_press", "click_point", "hover", "select", "type", "dance", "go_back", "type"]
_HANDLES = ["PHONE_MAIN", "PASSWORD_SITE1", "AADHAAR_X", "PASSWORD_B", "OTP_Z", "NOPE"]
_URLS = ["https://a.example/", "javascript:x", "not an address", "file:///etc"]
_nth = lambda values, k: f"[{', '.join(repr(v) for v in values)}][({k} % {len(values)} + 1)::INT]"
REQUESTS_SQL = f"""
  SELECT event_id, user_id AS run, {_nth(_KINDS, 'event_id')} AS type, CASE WHEN event_id % 23 <> 1 THEN event_id % 20 END AS target,
         CASE WHEN event_id % 3 = 0 THEN 'literal' ELSE 'placeholder' END AS value_kind, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'typed' END AS text,
         {_nth(_HANDLES, 'event_id')} AS handle, {_nth(_URLS, 'event_id')} AS url, CASE WHEN event_id % 4 = 1 THEN ' ' ELSE 'Enter' END AS keys,
         (event_id % 1500 - 100)::DOUBLE AS x, (event_id % 900 - 50)::DOUBLE AS y, event_id % 64 AS recent, 'https://s' || event_id % 3 || '.example' AS origin FROM events"""


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda v: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("run"), pick(_KINDS).alias("type"), F.when(k % 23 != 1, k % 20).alias("target"), F.when(k % 3 == 0, "literal").otherwise("placeholder").alias("value_kind"),
        F.when(k % 5 == 0, " ").otherwise("typed").alias("text"), pick(_HANDLES).alias("handle"), pick(_URLS).alias("url"), F.when(k % 4 == 1, " ").otherwise("Enter").alias("keys"),
        (k % 1500 - 100).cast("double").alias("x"), (k % 900 - 50).cast("double").alias("y"), (k % 64).alias("recent"), F.concat(F.lit("https://s"), k % 3, F.lit(".example")).alias("origin"),
    )


#: By element what its markup declares, and how surely.
DECLARED = [("email", 0.9), ("otp", 0.5), ("person_name", 0.6), ("face", 0.9)]
VERDICTS_SQL = f"""
  WITH a AS ({REQUESTS_SQL}), el AS (SELECT unnest(range(0, 18)) AS target), n AS (
    SELECT target, target % 7 = 3 AS hidden, target % 5 = 4 AS disabled, target % 2 = 0 AS editable, target % 4 IN (0, 2) AS asks_identity, ['text', 'password', 'tel', 'checkbox'][(target % 4 + 1)::INT] AS input_type FROM el),
  v AS (SELECT * FROM (VALUES ('PHONE_MAIN', 'phone', NULL, false), ('PASSWORD_SITE1', 'password', 'https://s1.example', true), ('AADHAAR_X', 'aadhaar', NULL, true), ('EMAIL_9', 'email', NULL, false)) AS v(handle, pii_type, site, confirm))
  SELECT event_id, run, CASE
      WHEN recent >= 60 THEN 'rate_limited'
      WHEN type IN ('noop', 'go_back') THEN 'ok'
      WHEN type = 'goto_url' THEN CASE WHEN NOT regexp_matches(url, '^[a-z][a-z0-9+.-]*:') THEN 'schema' WHEN NOT regexp_matches(url, '^https?:') THEN 'url_not_allowed' ELSE 'ok' END
      WHEN type = 'key_press' THEN CASE WHEN trim(keys) = '' THEN 'schema' ELSE 'ok' END
      WHEN type = 'click_point' THEN CASE WHEN x BETWEEN 0 AND 1280 AND y BETWEEN 0 AND 800 THEN 'ok' ELSE 'schema' END
      WHEN type = 'scroll' AND a.target IS NULL THEN 'ok'
      WHEN type = 'dance' THEN 'schema'
      WHEN n.target IS NULL THEN 'unknown_target'
      WHEN type IN ('scroll', 'hover') THEN 'ok'
      WHEN hidden OR disabled THEN 'not_interactable'
      WHEN type = 'click' THEN 'ok'
      WHEN type = 'select' THEN CASE WHEN value_kind = 'placeholder' AND v.handle IS NULL AND a.handle <> 'PASSWORD_B' THEN 'unresolvable_placeholder' ELSE 'ok' END
      WHEN NOT editable THEN 'not_interactable'
      WHEN value_kind = 'literal' THEN CASE WHEN asks_identity AND trim(text) <> '' THEN 'secret_target_mismatch' ELSE 'ok' END
      WHEN v.handle IS NULL AND a.handle <> 'PASSWORD_B' THEN 'unresolvable_placeholder'
      WHEN coalesce(v.pii_type, 'password') = 'password' THEN CASE WHEN input_type <> 'password' THEN 'secret_target_mismatch' WHEN site <> origin THEN 'wrong_site' ELSE 'ok' END
      WHEN input_type IN ('checkbox', 'password') OR input_type = 'tel' AND v.pii_type NOT IN ('phone', 'email') THEN 'secret_target_mismatch'
      WHEN confirm AND site IS NOT NULL AND site <> origin THEN 'wrong_site'
      ELSE 'ok' END AS code
  FROM a LEFT JOIN n ON a.target = n.target LEFT JOIN v ON a.handle = v.handle"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("id")
    declared = F.array(*[F.array(F.struct(F.lit(p).alias("pii_type"), F.lit(c).alias("confidence"))) for p, c in DECLARED])
    page = spark.range(18).select(
        t.alias("target"), (t % 7 == 3).alias("hidden"), (t % 5 == 4).alias("disabled"), (t % 2 == 0).alias("editable"), validate.asks_identity(F.get(declared, (t % 4).cast("int"))).alias("asks_identity"),
        F.get(F.array(*map(F.lit, ["text", "password", "tel", "checkbox"])), (t % 4).cast("int")).alias("input_type"),
    )
    store = spark.createDataFrame(
        [("PHONE_MAIN", "phone", None, False), ("PASSWORD_SITE1", "password", "https://s1.example", True), ("AADHAAR_X", "aadhaar", None, True), ("EMAIL_9", "email", None, False)],
        "handle string, pii_type string, site string, confirm boolean",
    )
    return validate.verdicts(requested(spark, sf_dir), page, store)


@query(f"SELECT event_id, code FROM ({VERDICTS_SQL})")
def action_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each proposed action's verdict, by the first check that refuses it; actions of all types."""
    return _judged(spark, sf_dir).select("event_id", "code")


@query(f"""
  WITH j AS (SELECT run, code, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS nth FROM ({VERDICTS_SQL}))
  SELECT run, coalesce(min(nth) FILTER (code <> 'ok'), count(*))::BIGINT AS index, coalesce(arg_min(code, nth) FILTER (code <> 'ok'), 'ok') AS code FROM j GROUP BY run""")
def first_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs up to their first refused action."""
    return validate.first_refusals(_judged(spark, sf_dir), "run", "event_id")


QUERIES, ORACLE = query.queries, query.oracle
