"""Latest rows, ranges, retention and bucketed aggregates over a time column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import time_bucket


def latest_by(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str) -> DataFrame:
    """The newest row of each key. max_by combines before the shuffle, so a hot key sends one row per task."""
    newest = F.max_by(F.struct(*df.columns), F.struct(F.col(ts), F.col(tiebreak)))
    return df.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")


def ts_range(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Both ends included; pushed to the scan."""
    return df.filter(F.col(ts).between(start, end))


def ttl_filter(df: DataFrame, ts: str, now: Column, seconds: int) -> DataFrame:
    """Rows not older than the retention."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def bucketed(df: DataFrame, width: str, ts: str, *aggs: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(time_bucket(width, F.col(ts)).alias("bucket"), *by).agg(*aggs)
