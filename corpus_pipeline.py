"""A training corpus from `documents`, stage by stage; each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, near_copies, source_mixing, token_ids, toxicity

#: Learned models and seeded rounding have no SQL form; the stages' operators are tested one by one.
ORACLE_SQL = None


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted to be toxic, each judged by its own text, with or without an id."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    score = common.free(docs, "score")
    return toxicity.score_rows(docs, labels, docs.columns, score=score).filter(F.col(score) < 0.5).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies (5-word Jaccard of 0.8 or more), once: operator 4 with 5-word shingles, checked
    by the sets, then, in blocks, what its fingerprints can't link (near_copies). Rows without an id stay. Of equal
    ids with different texts the smaller hash of the text stands for the group; of equal rows any, as only columns but these differ."""
    key = common.free(docs, "key")
    named = docs.filter("doc_id IS NOT NULL").withColumn(key, F.xxhash64("text"))
    kept = near_copies.chosen(named.select("doc_id", "text")).withColumnRenamed("key", key)
    kept = named.join(kept, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)
    return docs.filter("doc_id IS NULL").unionByName(kept)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of the benchmark's items: one window of one item is enough. Items of fewer words than a
    window (a word, a common phrase) mark no document."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.without_leaks(docs, items, least_items=1, shortest=decontamination.WINDOW)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes. Rows are numbered, and the numbers written, as ids may be null or repeated."""
    row, n = common.free(docs, "row"), common.free(docs, "copies")
    rows = common.cut(docs.withColumn(row, F.monotonically_increasing_id()))
    copies = common.cut(source_mixing.mix(rows, keep=(row,)).filter("copies > 0").select(row, F.col("copies").cast("int").alias(n)))
    common.tidy(spark)
    taken = rows.join(copies, row).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return taken.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the token file, as read back: doc_id, start, n_tokens and ids_crc32."""
    return token_ids.round_trip(docs)


STAGES = [
    ("toxicity", ordinary),
    ("simhash_dedup", one_of_each),
    ("decontamination", unseen),
    ("source_mixing", mixed),
    ("token_ids", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs
