"""Approximate nearest neighbours: an inverted file of cells around centroids.

`fit` takes centroids by k-means from a bounded sample of rows (SAMPLE a cell); `build` puts every row into the cell of its
nearest centroid and writes the index, a folder for each cell; `search` reads only the cells nearest to a query; `neighbours` does
the same for many queries at once. With as many probes as cells both are exact. Rows whose vector is null or of another size
are in no cell and are never found.

Cells are as uneven as the data. `neighbours` therefore deals a cell's rows into blocks of about BLOCK rows, sends its queries to
each block, and keeps k rows a query and block before it merges them, so no task holds a cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators import vector_search

#: Rows of the sample for each cell, steps of k-means, and rows of a block.
SAMPLE, STEPS, BLOCK = 64, 12, 8192


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray  # (cells, size)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids * self.centroids).sum(1)[None, :]

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(self.distances(x), axis=1, kind="stable")[:, :probes]


def fit(df: DataFrame, column: str, cells: int, seed: int = 42) -> Cells:
    """Centroids from at most SAMPLE * cells rows, those with the least hashes of their vectors."""
    sized = df.filter(F.col(column).isNotNull() & (F.size(column) > 0))
    some = sized.select(column).orderBy(F.xxhash64(column)).limit(SAMPLE * cells).toPandas()[column]
    if not len(some):
        raise ValueError("no vectors to fit cells to")
    size = len(some.iloc[0])
    x = np.stack([np.asarray(v, float) for v in some if len(v) == size])
    r = np.random.default_rng(seed)
    now = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(STEPS):
        own = Cells(now).nearest(x, 1)[:, 0]
        n = np.bincount(own, minlength=len(now))
        sums = np.zeros_like(now)
        np.add.at(sums, own, x)
        now = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], now)
    return Cells(now)


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this size, and the vectors."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan)
    return at, flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def placed(cells: Cells, column: str, probes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, x = matrix(b.column(b.schema.get_field_index(column)), cells.centroids.shape[1])
        probed = cells.nearest(x, probes)
        rows = b.take(pa.array(np.repeat(at, probed.shape[1])))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(probed.ravel().astype(np.int32))], [*rows.schema.names, "_cell"])


def assigned(df: DataFrame, column: str, cells: Cells, probes: int = 1) -> DataFrame:
    """df with the _cell of each row, a row for each of the probes nearest cells."""
    schema = StructType([*df.schema.fields, StructField("_cell", IntegerType())])
    return df.mapInArrow(lambda it: placed(cells, column, probes, it), schema)


def build(df: DataFrame, column: str, cells: Cells, path: str) -> None:
    """Every row of df, in a folder for its cell, and the centroids."""
    rows = assigned(df, column, cells)
    rows.write.partitionBy("_cell").option("compression", "zstd").parquet(f"{path}/rows")
    centroids = [(i, v.tolist()) for i, v in enumerate(cells.centroids)]
    df.sparkSession.createDataFrame(centroids, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def opened(spark: SparkSession, path: str) -> tuple[Cells, DataFrame]:
    found = sorted(spark.read.parquet(f"{path}/centroids").collect())
    return Cells(np.array([r.centroid for r in found])), spark.read.parquet(f"{path}/rows")


def search(spark: SparkSession, path: str, column: str, query: Sequence[float], k: int, key: str, probes: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows of the probes nearest cells; the other cells' folders aren't read."""
    cells, rows = opened(spark, path)
    near = cells.nearest(np.array([query], float), probes)[0].tolist()
    return vector_search.knn(rows.filter(F.col("_cell").isin(near)).drop("_cell"), column, query, k, key, metric)


def compared(k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """query, neighbour and distance: each query's k nearest of a block."""
    schema = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("distance", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    of = lambda t: (t.column("_id").to_numpy(), t.column("_v").combine_chunks().flatten().cast(pa.float64()).to_numpy().reshape(t.num_rows, -1))
    (q, x), (r, y) = of(left), of(right)
    order = np.argsort(r, kind="stable")
    r, y = r[order], y[order]
    out = []
    for i in range(0, len(q), 1024):
        d = np.sqrt(np.maximum((x[i : i + 1024] ** 2).sum(1)[:, None] - 2 * x[i : i + 1024] @ y.T + (y * y).sum(1)[None, :], 0))
        d[q[i : i + 1024, None] == r[None, :]] = np.inf  # a row isn't its own neighbour
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        own = np.take_along_axis(d, near, 1)
        keep = np.isfinite(own)
        out.append(pa.table([np.repeat(q[i : i + 1024], keep.sum(1)), r[near][keep], own[keep]], schema=schema))
    return pa.concat_tables(out)


def neighbours(df: DataFrame, queries: DataFrame, column: str, key: str, k: int, cells: Cells, probes: int) -> DataFrame:
    """query, neighbour, distance and rank: the k nearest other rows of df of each of queries (key, a whole number, and column)."""
    size = cells.centroids.shape[1]
    of = lambda d: d.select(F.col(key).cast("long").alias("_id"), F.col(column).alias("_v")).filter((F.size("_v") == size) & F.col("_id").isNotNull())
    rows, asked = assigned(of(df), "_v", cells), assigned(of(queries), "_v", cells, probes)
    blocks = rows.groupBy("_cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))  # a row a cell
    rows = rows.join(F.broadcast(blocks), "_cell").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    asked = asked.join(F.broadcast(blocks), "_cell").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    found = asked.groupBy("_cell", "_block").cogroup(rows.groupBy("_cell", "_block")).applyInArrow(lambda a, b: compared(k, a, b), "query long, neighbour long, distance double")
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
