"""Queries over stored values, routes, goals, settings and display arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import java, re2, sql
from ..operators import redact, store, validate
from ..sources.derived import table
from ..taxonomy import POLICIES
from .registry import Registry
from .text import _POLICY_SQL, policies

query = Registry()

_TYPES = [p.pii_type for p in POLICIES]
_ENTRY_SQL = f"""SELECT o_custkey AS owner, [{', '.join(f"'{t}'" for t in _TYPES)}][(o_orderkey % 27 + 1)::INT] AS pii_type, o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS at_ms,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'https://s' || o_orderkey % 5 || '.example' END AS site, 'value ' || o_orderkey AS value FROM orders"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner"), F.get(F.array(*map(F.lit, _TYPES)), (k % 27).cast("int")).alias("pii_type"), k.alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"),
        F.when(k % 3 != 0, F.concat(F.lit("https://s"), k % 5, F.lit(".example"))).alias("site"), F.concat(F.lit("value "), k).alias("value"),
    )


@query(f"""
  SELECT owner, pii_type, min(at_ms) AS created_at, max(at_ms) AS updated_at, arg_max(id, struct_pack(a := at_ms, i := id)) AS id, coalesce(array_to_string(list_sort(list_distinct(list(site) FILTER (WHERE site IS NOT NULL))), ','), '') AS used_on
  FROM ({_ENTRY_SQL}) GROUP BY ALL""")
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries upserted by owner and type: latest value, first creation, sites of use."""
    rows = entries(spark, sf_dir).withColumn("order", F.struct("at_ms", "id"))
    return store.upserted(rows.drop("value", "at_ms"), ["owner", "pii_type"], "order", "site").select(
        "owner", "pii_type", F.col("created_at.at_ms").alias("created_at"), F.col("updated_at.at_ms").alias("updated_at"), "id", F.array_join("used_on", ",").alias("used_on")
    )


@query(f"""
  SELECT e.id, p.lifetime, p.confirm AS gated, len(e.value)::BIGINT AS length, p.lifetime = 'ephemeral' AS ephemeral, p.lifetime = 'session' AS needs_reauth, upper(pii_type || '_' || replace(pii_type, '_', '') || n) AS token,
         CASE WHEN NOT p.confirm THEN 'use' WHEN e.site IS NULL THEN 'bind' WHEN e.site = 'https://s1.example' THEN 'use' ELSE 'refuse' END AS verdict
  FROM (SELECT *, row_number() OVER (PARTITION BY pii_type ORDER BY id) AS n FROM ({_ENTRY_SQL})) e JOIN {_POLICY_SQL} USING (pii_type)""")
def value_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without their values: length, lifetime, token, and whether a site may use them."""
    rows = store.next_slots(entries(spark, sf_dir), "id").join(F.broadcast(policies(spark)), "pii_type")
    return rows.select(
        "id", "lifetime", F.col("confirm").alias("gated"), F.length("value").cast("long").alias("length"), (F.col("lifetime") == "ephemeral").alias("ephemeral"), (F.col("lifetime") == "session").alias("needs_reauth"),
        store.token(F.col("pii_type"), F.col("slot")).alias("token"), validate.site_verdict(F.col("confirm"), F.col("site"), F.lit("https://s1.example")).alias("verdict"),
    )


@query(f"SELECT coalesce(p.lifetime, 'all') AS lifetime, count(*) AS n, count(DISTINCT owner) AS owners FROM ({_ENTRY_SQL}) JOIN {_POLICY_SQL} USING (pii_type) GROUP BY GROUPING SETS ((p.lifetime), ())")
def values_by_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries counted by lifetime and in all."""
    rows = entries(spark, sf_dir).join(F.broadcast(policies(spark)), "pii_type")
    return rows.rollup("lifetime").agg(F.count("*").alias("n"), F.count_distinct("owner").alias("owners")).select(F.coalesce("lifetime", F.lit("all")).alias("lifetime"), "n", "owners")


@query(f"""
  SELECT pii_type, lifetime, redaction, threshold, never_blur, confirm, CASE WHEN never_blur THEN 'mask_solid' ELSE 'blur' END AS blurred, count(*) AS entries
  FROM ({_ENTRY_SQL}) JOIN {_POLICY_SQL} USING (pii_type) GROUP BY ALL""")
def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies that stored entries fall under, what a request to blur becomes, and how many they are."""
    counts = entries(spark, sf_dir).groupBy("pii_type").agg(F.count("*").alias("entries"))
    return counts.join(F.broadcast(policies(spark)), "pii_type").withColumn("blurred", redact.resolve_mode(F.lit("blur"), F.col("redaction"), F.col("never_blur")))


_GOALS = ["fill the admission form", "show my attendance for march", "download the fee receipt of march", "update phone number", "check exam results"]
_ROUTE_SQL = f"""SELECT o_orderkey AS route, 'https://s' || o_custkey % 50 || '.example' AS origin, [{', '.join(f"'{g}'" for g in _GOALS)}][(o_orderkey % 5 + 1)::INT] || ' no' || o_orderkey % 7 AS goal,
  epoch_us(o_orderdate) // 1000 * 1000000 + o_orderkey AS saved_at, (o_orderkey % 30)::INT AS steps FROM orders"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    goal = F.concat(F.get(F.array(*map(F.lit, _GOALS)), (k % 5).cast("int")), F.lit(" no"), k % 7)
    return table(spark, sf_dir, "orders").select(
        k.alias("route"), F.concat(F.lit("https://s"), F.col("o_custkey") % 50, F.lit(".example")).alias("origin"), goal.alias("goal"),
        (F.unix_millis(F.col("o_orderdate").cast("timestamp")) * 1000000 + k).alias("saved_at"), (k % 30).cast("int").alias("steps"),
    )


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: len(w) > 2))"
_OVERLAP = "(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE)"


@query(f"""
  WITH r AS (SELECT *, {_WORDS.format('goal')} AS w FROM ({_ROUTE_SQL})), q AS (SELECT c_custkey AS k, 'https://s' || c_custkey % 60 || '.example' AS origin, {_WORDS.format("'please ' || [" + ', '.join(f"'{g}'" for g in _GOALS) + "][(c_custkey % 5 + 1)::INT]")} AS w FROM customer),
  m AS (SELECT a.k, b.route, {_OVERLAP} AS share, row_number() OVER (PARTITION BY a.k ORDER BY {_OVERLAP} DESC, b.saved_at DESC) AS rank FROM q a JOIN r b USING (origin) WHERE {_OVERLAP} >= 0.5)
  SELECT k, route, round(share, 6) AS share FROM m WHERE rank = 1""")
def recalled_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each request the route of its site that shares most words."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("https://s"), k % 60, F.lit(".example")).alias("origin"), F.concat(F.lit("please "), F.get(F.array(*map(F.lit, _GOALS)), (k % 5).cast("int"))).alias("goal"))
    return store.recalled(asked, routes(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"""
  WITH r AS (SELECT *, {_WORDS.format('goal')} AS w FROM ({_ROUTE_SQL})), l AS (SELECT a.* FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.origin = b.origin AND b.saved_at > a.saved_at AND {_OVERLAP} >= 0.5)),
  n AS (SELECT *, row_number() OVER (ORDER BY saved_at DESC, route)::INT AS place FROM l) SELECT route, origin, saved_at, least(steps, 24) AS steps, place FROM n WHERE place <= 40""")
def remembered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty latest routes without superseded ones: the limit is the feature."""
    return store.remembered(routes(spark, sf_dir))


# Words that ask to fill in a form, and that ask a question.
FILL = r"\b(?:fill\w*|enter\w*|typ(?:e|ing)|input|register|registration|sign\s*up|signup|log\s*in|login|log\s*on|sign\s*in|signin|submit|apply|application|complete\s+(?:the\s+)?form|update\s+my)\b"
READ = r"\b(?:whats?|which|who|whose|whom|when|where|why|how\s+(?:many|much|long|old)|summar\w*|describ\w*|explain|tell\s+me|read|list\s+(?:out|all|the)|is\s+there|are\s+there|does\s+it|check\s+if|find\s+out|show\s+me\s+what)\b"
_TASKS = ["Log in and tell me my attendance", "whats on this page", "Open the second link", "how many seats are there", "fillout the form", "summarise it", "submit", "scroll down", "check if it works", "apply for a pass"]
# Rows of each kind that a prompt may show, by goal.
BUDGETS = {"read": (60, 160), "fill": (140, 60), "act": (140, 40)}


def _goal_sql(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, {sql(re2(FILL, True))}) THEN 'fill' WHEN regexp_matches({v}, {sql(re2(READ, True))}) THEN 'read' ELSE 'act' END"


def classify_goal(task):
    return F.when(task.rlike(java(FILL, True)), "fill").when(task.rlike(java(READ, True)), "read").otherwise("act")


_TASK_SQL = f"SELECT c_custkey AS k, [{', '.join(sql(t) for t in _TASKS)}][(c_custkey % 10 + 1)::INT] AS task FROM customer UNION ALL SELECT -1 - (conv_id * 1000 + turn), text FROM conversations WHERE role = 'user'"


@query(f"SELECT k, {_goal_sql('task')} AS goal, CASE {_goal_sql('task')} " + " ".join(f"WHEN '{g}' THEN {a}" for g, (a, _) in BUDGETS.items()) + f" END AS actionable, CASE {_goal_sql('task')} " + " ".join(f"WHEN '{g}' THEN {c}" for g, (_, c) in BUDGETS.items()) + f" END AS context FROM ({_TASK_SQL})")
def goal_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by what they ask for, with the budgets that follow."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(k.alias("k"), F.get(F.array(*map(F.lit, _TASKS)), (k % 10).cast("int")).alias("task"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).alias("k"), F.col("text").alias("task"))
    rows = own.unionByName(turns).select("k", classify_goal(F.col("task")).alias("goal"))
    pick = lambda at: F.element_at(F.create_map(*[F.lit(x) for g, v in BUDGETS.items() for x in (g, v[at])]), F.col("goal"))
    return rows.select("k", "goal", pick(0).alias("actionable"), pick(1).alias("context"))


@query("""
  WITH e AS (SELECT l_orderkey AS page, l_linenumber AS n, l_linenumber % 2 = 0 AS editable, l_quantity > 25 AS visible FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY editable DESC, visible DESC, n) AS rank FROM e)
  SELECT page, string_agg(n::VARCHAR, ',' ORDER BY n) AS shown, count(*) AS n FROM r WHERE rank <= 3 OR editable GROUP BY page""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a page within a budget of three: editable ones always, then visible ones, in page order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") % 2 == 0).alias("editable"), (F.col("l_quantity") > 25).alias("visible"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("editable"), F.desc("visible"), "n"))
    kept = rows.withColumn("rank", rank).where("rank <= 3 or editable")
    return kept.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("n")), lambda x: x.cast("string")), ",").alias("shown"), F.count("*").alias("n"))


@query("""
  SELECT p_partkey AS k, CASE WHEN p_partkey * 7919 < 1024 THEN p_partkey * 7919 || ' B' WHEN p_partkey * 7919 < 1048576 THEN floor(p_partkey * 7919 / 1024.0 + 0.5)::BIGINT || ' KB' ELSE floor(p_partkey * 7919 / 1048576.0 * 10 + 0.5)::BIGINT // 10 || ' MB' END AS size,
         floor(len('data:image/png;base64,' || repeat('QUJD', (p_size)::INT)) - strpos('data:image/png;base64,', ','))::BIGINT * 3 // 4 AS image_bytes,
         regexp_replace('click el_' || p_partkey || ' then px_3, not hel_4', '\\b(el|px)_[0-9]+\\b', '<expired>', 'g') AS expired,
         CASE WHEN p_size < 10 THEN 'short' WHEN p_size % 2 = 0 THEN 'digits' WHEN p_size % 3 = 0 THEN 'few_characters' END AS passphrase FROM part""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes for people, bytes of a data address, expired ids in history, weak passphrases."""
    k, n = F.col("p_partkey"), F.col("p_partkey") * 7919
    size = F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1048576, F.concat(F.floor(n / 1024 + 0.5), F.lit(" KB"))).otherwise(F.concat(F.expr("floor(p_partkey * 7919 / 1048576 * 10 + 0.5) div 10"), F.lit(" MB")))
    url = F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("QUJD"), F.col("p_size")))
    phrase = F.when(F.col("p_size") % 2 == 0, F.repeat(F.lit("1"), F.col("p_size"))).when(F.col("p_size") % 3 == 0, F.repeat(F.lit("a"), F.col("p_size"))).otherwise(F.repeat(F.lit("abcdef"), F.col("p_size")))
    phrase = F.when(F.col("p_size") < 10, F.lit("abcdef")).otherwise(phrase)
    return table(spark, sf_dir, "part").select(
        k.alias("k"), size.alias("size"), F.floor((F.length(url) - F.instr(url, ",")) * 3 / 4).alias("image_bytes"),
        F.regexp_replace(F.concat(F.lit("click el_"), k, F.lit(" then px_3, not hel_4")), java(r"\b(?:el|px)_[0-9]+\b"), "<expired>").alias("expired"), store.passphrase_problem(phrase).alias("passphrase"),
    )


@query("""
  SELECT s_suppkey AS k, CASE (s_suppkey % 8) WHEN 0 THEN 'auth' WHEN 1 THEN 'not_found' WHEN 2 THEN 'too_large' WHEN 3 THEN 'busy' WHEN 4 THEN 'server' ELSE 'other' END AS problem, s_suppkey % 8 IN (3, 4) AS retryable,
    CASE s_suppkey % 5 WHEN 0 THEN 'no_base_url' WHEN 1 THEN 'insecure_remote' WHEN 2 THEN 'ok' WHEN 3 THEN 'bad_base_url' ELSE 'ok' END AS settings FROM supplier""")
def service_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a service by status, and settings by what is wrong with them."""
    k = F.col("s_suppkey")
    status = F.get(F.array(*map(F.lit, [401, 404, 413, 429, 503, 400, 418, 409])), (k % 8).cast("int"))
    url = F.get(F.array(F.lit(""), F.lit("http://far.example/v1"), F.lit("http://127.0.0.1:8000/v1"), F.lit("no address"), F.lit("https://far.example")), (k % 5).cast("int"))
    host = F.try_parse_url(url, F.lit("HOST"))
    local = host.rlike(r"\A(?:localhost|127(?:\.[0-9]+){3}|\[::1\]|.*\.localhost)\z")
    problem = F.when(status.isin(401, 403), "auth").when(status == 404, "not_found").when(status == 413, "too_large").when(status == 429, "busy").when(status >= 500, "server").otherwise("other")
    settings = F.when(url == "", "no_base_url").when(~url.rlike("(?i)^https?://") | host.isNull(), "bad_base_url").when(url.rlike("(?i)^http:") & ~local, "insecure_remote").otherwise("ok")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), problem.alias("problem"), problem.isin("busy", "server").alias("retryable"), settings.alias("settings"))


@query("""
  WITH l AS (SELECT doc_id, quality = 1 AS wanted, doc_id % 3 <> 0 AS flagged FROM labels),
  c AS (SELECT count(*) FILTER (WHERE wanted AND flagged) AS tp, count(*) FILTER (WHERE NOT wanted AND flagged) AS fp, count(*) FILTER (WHERE wanted AND NOT flagged) AS fn FROM l)
  SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS "precision", round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp)::DOUBLE, 6) AS f2 FROM c""")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and F2 of a rule against labels (the arithmetic; labels are of quality)."""
    w, f = F.col("quality") == 1, F.col("doc_id") % 3 != 0
    c = table(spark, sf_dir, "labels").agg(F.count_if(w & f).alias("tp"), F.count_if(~w & f).alias("fp"), F.count_if(w & ~f).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", F.round(tp / (tp + fp), 6).alias("precision"), F.round(tp / (tp + fn), 6).alias("recall"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"), F.round(5 * tp / (5 * tp + 4 * fn + fp), 6).alias("f2"))


QUERIES, ORACLE = query.queries, query.oracle
