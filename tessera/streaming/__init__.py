"""Streaming twins of the time-series operators; the plans are the batch ones with a watermark in front."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType, TimestampNTZType

from tessera.functions.scalar import bucket_seconds


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bucketed(stream: DataFrame, width: str, ts: str, late: str, *aggs: Column, by: Sequence[str] = ()) -> DataFrame:
    """Tumbling aggregates; rows later than the watermark are dropped and state is bounded by it. Times without a zone, which
    Spark's watermarks don't take, are read as the session zone's, and so are the buckets."""
    if isinstance(stream.schema[ts].dataType, TimestampNTZType):
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    window = F.window(F.col(ts), f"{bucket_seconds(width)} seconds")
    grouped = stream.withWatermark(ts, late).groupBy(window.alias("_w"), *by).agg(*aggs)
    return grouped.select(F.col("_w.start").alias("bucket"), *[c for c in grouped.columns if c != "_w"])


def latest_by(stream: DataFrame, keys: Sequence[str], ts: str, tiebreak: str) -> DataFrame:
    """Newest row per key so far (complete or update mode)."""
    newest = F.max_by(F.struct(*stream.columns), F.struct(F.col(ts), F.col(tiebreak)))
    return stream.groupBy(*keys).agg(newest.alias("_row")).select("_row.*")


def ingest(stream: DataFrame, path: str, checkpoint: str, ts: str) -> StreamingQuery:
    """Append to the day-partitioned store; run until what is there has been read."""
    dated = stream.withColumn("_day", F.to_date(F.col(ts)))
    return (
        dated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("_day").outputMode("append").trigger(availableNow=True).start()
    )
