"""Joins that SQL words and the DataFrame API doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, column: str, right: DataFrame, of: str) -> DataFrame:
    """Rows of left whose column is NOT IN right's `of`, as SQL has it: none if that has a null; all, nulls too, if it is
    empty; else those whose column is neither null nor there. A hash or sort join by the key, with one row that says how
    many rows and nulls there are, so that neither side is broadcast whole."""
    listed = right.select(F.col(of).alias("_listed"))
    counts = listed.agg(F.count("*").alias("_all"), F.count_if(F.col("_listed").isNull()).alias("_nulls"))
    apart = left.join(listed, left[column] == F.col("_listed"), "left_anti").crossJoin(F.broadcast(counts))  # one row
    kept = (F.col("_all") == 0) | ((F.col("_nulls") == 0) & left[column].isNotNull())
    return apart.filter(kept).select(*[left[c] for c in left.columns])
