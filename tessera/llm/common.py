"""What the operators share: Arrow batches as numpy arrays, settings, shared folders."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20
CHUNK_BYTES = 1 << 19
#: Rows of some numbers and a name that may be broadcast.
FEW = 100_000
#: The driver's heap in use, as a share, from which tables are written after a collection, and how much came since the last one.
FULL, SINCE = 0.5, 0.15

_left = 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset (tests), one is set in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoint"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """df from a table in the shared folder: later stages don't run it again, and no executor's loss removes it. Tables of
    `spent`, which cut has returned before and nothing needs any more, are deleted."""
    path = new_path(df.sparkSession, "table")
    if crowded(df.sparkSession):
        tidy(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    drop(*spent)
    return out


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """df, which is dealt out by key into `parts` partitions, from a table in the shared folder in as many buckets, so that
    joins by the key don't shuffle it again. The table is known to the session's catalog."""
    spark, path, table = df.sparkSession, new_path(df.sparkSession, name), f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out.cut_path, out.cut_name = path, table
    return out


def drop(*spent: DataFrame) -> None:
    """Deletes the tables of what cut and bucketed have returned."""
    for df in spent:
        if hasattr(df, "cut_name"):
            df.sparkSession.sql(f"DROP TABLE {df.cut_name}")
        delete(df.sparkSession, df.cut_path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage. A stage of many queries leaves plans and their texts there, and a heap that has grown for these
    doesn't shrink before a full collection."""
    global _left
    gc.collect()  # what Python holds of the JVM's objects
    spark._jvm.System.gc()
    _left = heap(spark)


def heap(spark: SparkSession) -> float:
    """The driver's heap in use, as a share of what it may have."""
    jvm = spark._jvm.java.lang.Runtime.getRuntime()
    return (jvm.totalMemory() - jvm.freeMemory()) / jvm.maxMemory()


def crowded(spark: SparkSession) -> bool:
    """Whether the driver's heap has filled since it was last tidied, so that it would grow."""
    now = heap(spark)
    return now > FULL and now - _left > SINCE


def arrow_limits(spark: SparkSession) -> None:
    """Batches to Python of bounded bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def crc32_fold(doc_id: str, of: int):
    """The remainder of crc32(doc_id as text)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of
