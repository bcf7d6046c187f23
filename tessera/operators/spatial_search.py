"""Nearest points: an exact scan, and a grid of cells that reads only what is near."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import spatial as S


def st_knn(df: DataFrame, column: str, at: tuple[float, ...], k: int, key: str) -> DataFrame:
    """The k rows nearest to a place, ties by key. Each task keeps k rows (TakeOrderedAndProject), in one scan."""
    near = df.filter(F.col(column).isNotNull()).withColumn("_distance", S.distance(F.col(column), *at))
    return near.orderBy("_distance", key).limit(k).select(*df.columns)


def cell(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("long")


def build_grid(df: DataFrame, column: str, width: float, path: str) -> None:
    """Every row of df with its cell of a grid of cubes, sorted by cell, so that row groups have narrow ranges of cells."""
    cells = [cell(F.col(f"{column}.{a}"), width).alias(f"_c{a}") for a in "xyz"]
    rows = df.select("*", *cells)
    order = ["_cx", "_cy", "_cz"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)


def within(rows: DataFrame, width: float, at: tuple[float, float, float], reach: float) -> DataFrame:
    """Rows of a grid in the cells that a cube of 2 * reach around a place meets."""
    out = rows
    for a, v in zip("xyz", at, strict=True):
        out = out.filter(F.col(f"_c{a}").between(floor((v - reach) / width), floor((v + reach) / width)))
    return out


def grid_radius(spark: SparkSession, path: str, column: str, width: float, at: tuple[float, float, float], radius: float) -> DataFrame:
    """Rows within a radius of a place."""
    rows = within(spark.read.parquet(path), width, at, radius)
    return rows.filter(S.distance(F.col(column), *at) <= radius).drop("_cx", "_cy", "_cz")


def grid_range(spark: SparkSession, path: str, column: str, width: float, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Rows in a box, its faces included."""
    out = spark.read.parquet(path)
    for a, v, w in zip("xyz", low, high, strict=True):
        out = out.filter(F.col(f"_c{a}").between(floor(v / width), floor(w / width)) & F.col(f"{column}.{a}").between(v, w))
    return out.drop("_cx", "_cy", "_cz")


def grid_knn(spark: SparkSession, path: str, column: str, width: float, at: tuple[float, float, float], k: int, key: str) -> DataFrame:
    """The k nearest rows, ties by key: cubes around the place grow until k rows are within reach, which makes the result
    exact; if the grid has fewer, or they are very far, all rows are scanned."""
    rows, reach = spark.read.parquet(path), width
    for _ in range(24):
        near = st_knn(within(rows, width, at, reach), column, at, k, key)
        far = near.agg(F.count("*"), F.max(S.distance(F.col(column), *at))).first()
        if far[0] == k and far[1] <= reach:
            return near.drop("_cx", "_cy", "_cz")
        reach *= 4
    return st_knn(rows, column, at, k, key).drop("_cx", "_cy", "_cz")
