"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that cross to Python in one Arrow batch. Documents can be long, so the
#: batch is small enough that two of them fit a modest Python worker.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Where that is unset, a session on one machine (tests)
    sets and uses a folder beside its warehouse; on a cluster there is none that all would see.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or None
    if path is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_palisade"
        if "://" not in path and not path.startswith("file:"):
            path = "file://" + path
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which a write deletes its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    """Writes and rereads. The write's shuffle files go when it ends, as its rows are safe then;
    they would stay until the driver's next collection of garbage otherwise."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as compressed Parquet to the shared folder and reread."""
    return _write(df, fresh_path(df.sparkSession, name))


class Scratch:
    """Tables in the shared folder that an operator needs for a while."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """As ``written``; unless it is to be kept, ``clear`` deletes it."""
        path = fresh_path(self.spark, name)
        out = _write(df, path)
        if not keep:
            self.paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that nothing will read again."""
        path = self.paths.pop(id(df))[1]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def clear(self) -> None:
        """Deletes all: what was made of them has been written."""
        for df, _ in list(self.paths.values()):
            self.drop(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    r"""Array of the words ``[^\x20\x09-\x0D]+`` of a text; null: no words."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Holds Arrow batches to so many rows for this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def pieces(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of texts of so many bytes together, or a single longer text."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0)).cumsum()
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end
