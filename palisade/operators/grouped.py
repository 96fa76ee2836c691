"""Groups whose result depends on the order in which their rows are met."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups that go through Python in one Arrow batch.
BATCH_GROUPS = 4096
_ARROW = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def by_group(rows: DataFrame, keys: list[str], columns: list[str | Column], fn: Callable[[list[list]], list[tuple]], schema: str) -> DataFrame:
    """fn(values of each of ``columns``, in order of ``columns``) -> result rows, without the keys, of each group; (keys, ``schema``).

    Groups are gathered by Spark and come to Python many in one Arrow batch, as a call for each group costs
    more than the work on its few rows. A group is one row in one task.
    """
    spark = rows.sparkSession
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    kinds = dict(rows.dtypes)
    out_schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_GROUPS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_GROUPS))
    arrow = [_ARROW[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat = lists.flatten()
            ends = lists.value_lengths().to_pylist()
            values = [c.to_pylist() for c in flat.flatten()]
            whose: list[int] = []
            out: list[tuple] = []
            at = 0
            for k, n in enumerate(ends):
                more = fn([v[at : at + n] for v in values])
                whose += [k] * len(more)
                out += more
                at += n
            if out:
                own = [b.column(c).take(pa.array(whose, pa.int64())) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True))], names=names)

    return packed.mapInArrow(run, out_schema)
