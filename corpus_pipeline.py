"""A corpus pipeline of five stages: quality rules, fuzzy line dedup, near-duplicate
documents, mixing sources to weights, BPE encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
their input; ``run`` writes each stage's rows as Parquet to the session's shared folder
and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, lines, mixing, quality, simhash
from palisade.llm.common import table, written
from palisade.llm.queries import vocabulary

#: Weights of the sources in order of code points, repeating, and the most copies of a document.
WEIGHTS, MAX_COPIES = (1, 2, 3), 3


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where the table has it, follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand in an earlier place; a document that loses its
    last word by that goes, as all it said is said elsewhere."""
    found = lines.deduplicated(docs)
    return _with_length(found.where((F.col("__n_dropped") == 0) | F.col("text").rlike(r"[^ \t-\r]")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs, similarity=0.8, shingle=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+"))
    return mixing.repeated(docs, words, weights=WEIGHTS, max_copies=MAX_COPIES)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document of the mix."""
    encoded = bpe.encode(docs, vocabulary("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]

#: SQL has neither XXH3 nor the iterations over links; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: (doc_id, n_tokens, ids) of the mix."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
