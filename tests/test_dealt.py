"""Rows of which much is made, dealt by their number."""

from pyspark.sql import functions as F


def test_one_group_of_rows_goes_to_many_tasks(spark, tmp_path):
    from palisade.sources import derived

    path = f"file://{tmp_path}/orders.parquet"
    spark.range(10 * derived.TASK_ROWS).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(path)
    rows = derived.id_candidates(spark, f"file://{tmp_path}").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    kinds = 9
    assert len(rows) >= 10 and max(r.n for r in rows) <= 2 * kinds * derived.TASK_ROWS
    assert sum(r.n for r in rows) == 10 * kinds * derived.TASK_ROWS


def test_rows_of_fields_are_dealt_and_judged_as_before(spark, tmp_path):
    from palisade.queries import QUERIES

    rows = [(k, k % 7, f"name {k}") for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_name string").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    signals, verdicts = QUERIES["field_signals"](spark, f"file://{tmp_path}").collect(), QUERIES["conflicting_signals"](spark, f"file://{tmp_path}")
    declared = {}
    for r in signals:
        declared.setdefault(r.k, set()).add(r.pii_type)
    seen = ["aadhaar", "email", "person_name", "otp"]
    assert {(r.k, r.conflicting) for r in verdicts.collect()} == {(k, seen[k % 4] not in d) for k, d in declared.items()}
    assert verdicts.rdd.getNumPartitions() > 1


def test_a_leading_boundary_is_short_only_before_a_word_character():
    from palisade.functions.dialect import java

    for plain in (r"\b[A-Z]{3}\d{7}\b", r"\b(?:\d[ -]?){12,18}\d\b", r"\b(?:a\/c|acc(?:oun)?t|bank)\b"):
        assert java(plain).startswith("(?<![A-Za-z0-9_])" + plain[2:4])
    for other in (r"\b[A-Z._]+@", r"\ba?-", r"\b(?:a|-)x", r"\b(?:ab)?-", r"\b(?:ab){0,2}-", r"\ba|b", r"\b\s", r"\b[^a]", r"\b(?:0?[1-9])"):
        assert java(other).startswith("(?:(?<=[A-Za-z0-9_])(?!")
