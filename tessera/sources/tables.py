"""Parquet tables, read lazily so that filters and column lists reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory; any file system that Spark reads."""
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columnar sink; zstd pages keep wide scans cheap."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def append_time_series(df: DataFrame, path: str, ts: str) -> None:
    """Append rows to a store partitioned by day, sorted by time within files for row-group pruning.

    Rows may arrive in any order; null times go to the default partition and are never pruned away by accident.
    """
    day = "_day"
    dated = df.withColumn(day, F.to_date(F.col(ts)))
    dated.repartition(F.col(day)).sortWithinPartitions(day, ts).write.mode("append").partitionBy(day).parquet(path)


def read_time_range(spark: SparkSession, path: str, ts: str, start: Column, end: Column, columns: list[str]) -> DataFrame:
    """Rows with start <= ts <= end; the day filter prunes directories, the time filter row groups."""
    df = spark.read.parquet(path)
    days = F.col("_day").between(F.to_date(start), F.to_date(end))
    return df.filter(days & F.col(ts).between(start, end)).select(*columns)
