"""Nearest neighbours by an exact scan with a bounded heap; vector_index has the approximate search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector as V


def knn(df: DataFrame, column: str, query: Sequence[float], k: int, key: str, metric: str = "l2", distance: str = "distance") -> DataFrame:
    """The k rows with the least distance, ties by key; rows without a vector have none. Each task keeps k rows (TakeOrderedAndProject)."""
    scored = df.filter(F.col(column).isNotNull()).withColumn(distance, V.METRICS[metric](F.col(column), V.literal(query)))
    return scored.orderBy(F.col(distance), F.col(key)).limit(k)


def knn_search(df: DataFrame, column: str, query: Sequence[float], k: int, key: str, metric: str = "l2") -> DataFrame:
    """Rows of df that are the k nearest, in one scan."""
    return knn(df, column, query, k, key, metric, "_distance").select(*df.columns)
