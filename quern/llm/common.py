"""Spark helpers of the operators: shared folder, checked broadcasts, Arrow batches, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import bound_batches, let_workers_import, shared_folder

#: Rows of an id table that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """What each operator needs of a session: importable workers, bounded Arrow batches, a shared checkpoint folder.

    What the operators write there goes when the session ends.
    """
    let_workers_import(spark)
    sc = spark.sparkContext
    bound_batches(spark)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
        fs, path = filesystem(spark, sc.getCheckpointDir())  # a folder of this session's own
        fs.deleteOnExit(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{new_name(name)}"


def delete(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder: later steps read them back and survive the loss of executors."""
    return df.checkpoint(eager=True)


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever dots or spaces are in it."""
    return df["`" + name.replace("`", "``") + "`"]


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns that an operator works on, under names of its own, so that others can't clash."""
    return df.select(*[column(df, source).alias(own) for own, source in names.items()])


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join with a broadcast hint if its counted rows allow it; else unchanged, and the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def new_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def row_key(*columns: Column) -> tuple[Column, Column]:
    """128 bits of the values of some columns, nulls told apart: a name for rows that have none of their own."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(0), *parts), F.xxhash64(F.lit(1), *parts)


def without_rows(docs: DataFrame, names: tuple[str, ...], gone: DataFrame) -> DataFrame:
    """docs without the rows whose values of the named columns have a key (row_key) that is in the two columns of gone."""
    keys = [new_name("key"), new_name("key")]
    gone = cut(gone.toDF(*keys).distinct())
    own = row_key(*[column(docs, n) for n in names])
    return docs.join(small(gone, gone.count()), (own[0] == F.col(keys[0])) & (own[1] == F.col(keys[1])), "left_anti")
