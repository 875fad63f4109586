"""Sources of records: Parquet tables, JDBC tables split by key, JSON seeds, increments and single records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A database table read in key ranges, one a task."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, **options)
    return reader.load()


def json_seed(spark: SparkSession, path: str) -> DataFrame:
    """(title, body, author, language) of a file with one object that lists posts."""
    schema = "posts array<struct<title:string,body:string,author:string,language:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("posts"))


def since(records: DataFrame, column: str, at: str) -> DataFrame:
    """Records changed at or after a time."""
    return records.where(F.col(column) >= F.lit(at).cast("timestamp"))


def by_key(records: DataFrame, key: str, keys: list) -> DataFrame:
    return records.where(F.col(key).isin(keys))


def first_then_rest(records: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The n records of the lowest keys, and those after them."""
    first = records.orderBy(key).limit(n)
    last = first.agg(F.max(key).alias("__last"))
    return first, records.crossJoin(F.broadcast(last)).where(F.col("__last").isNull() | (F.col(key) > F.col("__last"))).drop("__last")


def append(records: DataFrame, path: str, partition_by: list[str]) -> None:
    records.write.mode("append").partitionBy(*partition_by).parquet(path)
