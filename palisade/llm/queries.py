"""The queries opN_ over the test tables, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, divergence, fingerprints, html_extract, lines, mixing, packing, quality, records, sharding, simhash, token_counts
from .common import table, written


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3, bits=64)
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return records.token_records(docs, vocabulary("word_bpe_49k.json"), end_id=1)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    found = mixing.mixed(written(docs, "sizes"), F.col("size"), weights=(1, 2, 3), max_copies=3, key=F.col("key"))
    return found.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("size")).alias("taken"),
    )


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compared_with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, size=1024)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"), damage=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_groups, op2_quality_rules, op3_token_records, op4_line_dedup, op5_source_mix, op6_bpe_round_trip, op7_shards,
        op8_main_text, op9_fingerprints, op10_token_counts, op11_source_divergence, op12_best_fit_packing, op13_conversation_repair,
    )
}

_WORDS = r"""string_split_regex(coalesce(text, ''), '[ \t-\r]+')"""

OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text, list_filter({_WORDS}, lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM d
), g AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k
), m AS (
  SELECT w.doc_id, w.text,
         len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS without_letters,
         len(regexp_extract_all(text, '(?m)^[ \t]*[-*•]')) AS bullets,
         len(regexp_extract_all(text, '(?m)(\.\.\.|…)[ \t]*$')) AS ellipses
  FROM w LEFT JOIN covered USING (k)
), b AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars < {quality.MIN_WORD_CHARS} * n_words OR word_chars > {quality.MAX_WORD_CHARS} * n_words
            OR 100 * n_symbols > {quality.MAX_SYMBOLS_PERCENT} * n_words
            OR 100 * n_dup_lines > {quality.MAX_DUP_LINES_PERCENT} * n_lines
            OR 100 * without_letters > {100 - quality.MIN_ALPHA_PERCENT} * n_words
            OR 100 * bullets > {quality.MAX_BULLET_PERCENT} * n_lines
            OR 100 * ellipses > {quality.MAX_ELLIPSIS_PERCENT} * n_lines) AS kept
FROM b
"""

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {divergence.LEAST_DOCS}
), n AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), size AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) + 5 * v))::BIGINT AS p
  FROM g JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN n USING (lang, source, term)
), langs AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v))::BIGINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) JOIN size USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), above AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares JOIN langs USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (FROM all_pairs UNION ALL BY NAME FROM above)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

def _plus(best: str, cost: int | str, labels: str) -> str:
    """A state's best (cost in nine digits, then labels) with a cost and a label more."""
    return f"(lpad((left({best}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({best}, 10) || {labels})"


#: The best edits row by row: for each state of the grammar the cheapest cost (nine digits) and labels so far.
OP13_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
), fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS fate
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fates WHERE fate <> 0
), placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS init, row_number() OVER o AS i, lag(left(role, 1)) OVER o AS before
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*$') THEN 't' ELSE '-' END AS fault
  FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND before || init NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), best AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i,
    {_plus('v0', '3', "'D'")},
    least({_plus('v1', '3', "'D'")}, CASE WHEN keeps AND init = 's' THEN {_plus('v0', 'late', "'K'")} END),
    least({_plus('x2', '3', "'D'")}, CASE WHEN keeps THEN {_plus('least(v0, v1, x3)', "late + if(init = 'u', 0, 2)", "if(init = 'u', 'K', 'R')")} END),
    least({_plus('x3', '3', "'D'")}, CASE WHEN keeps THEN {_plus('x2', "late + if(init = 'a', 0, 2)", "if(init = 'a', 'K', 'R')")} END)
  FROM (
    SELECT *, least(v3, {_plus('x2', '2', "'I'")}) AS x3 FROM (
      SELECT r.conv_id, r.i, init, fault IN ('-', 't') AS keeps, if(fault = 't', 1, 0) AS late, v0, v1, v3,
             least(v2, {_plus('least(v0, v1, v3)', '2', "'I'")}) AS x2
      FROM best JOIN r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i + 1))
), chosen AS (
  SELECT conv_id, left(w, 9)::BIGINT AS cost, substr(w, 10) AS audit FROM (
    SELECT best.conv_id, least(v0, v3, {_plus('v2', '2', "'I'")}, {_plus('v1', '4', "'II'")}) AS w
    FROM best JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id AND i = n)
), walk AS (
  SELECT conv_id, audit, 0 AS p, 0::BIGINT AS i, '-' AS q, []::VARCHAR[] AS lines FROM chosen
  UNION ALL
  SELECT walk.conv_id, audit, p + 1, walk.i + if(audit[p + 1] = 'I', 0, 1), if(audit[p + 1] = 'D', q, said[1]),
         if(audit[p + 1] = 'D', lines, list_append(lines, said || ':' || if(audit[p + 1] = 'I', '', text)))
  FROM (
    SELECT walk.*, r.text, CASE audit[p + 1] WHEN 'K' THEN r.role ELSE if(q = 'u', 'assistant', 'user') END AS said
    FROM walk LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.i = walk.i + 1 WHERE p < length(audit)) AS walk
), texts AS (
  SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS sha FROM walk WHERE p = length(audit)
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

ORACLE: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op11_source_divergence": OP11_SQL, "op13_conversation_repair": OP13_SQL}
