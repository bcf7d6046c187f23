"""Queries sent as the engine's own SQL text through session.Database, and those of stores, streams and indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import spatial as S
from tessera.functions import text as T
from tessera.operators import fulltext, spatial_search, vector_index
from tessera.session import Database
from tessera.sources import append_time_series, load, read_time_range

QUERIES, ORACLES = {}, {}


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def database(spark: SparkSession, sf_dir: str, *tables: str) -> Database:
    db = Database(spark, shared(spark, "database"))
    for table in tables:
        db.register(table, f"{sf_dir.rstrip('/')}/{table}.parquet", time="ts" if table == "events" else None)
    return db


def sent(name: str, sql: str, oracle: str, *tables: str, before: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, *tables)
        for statement in before:
            db.execute(statement)
        return db.execute(sql)

    QUERIES[name], ORACLES[name] = run, oracle


sent(
    "sql_cast",
    "SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS whole, CAST(c_custkey, 'TEXT') AS name, CAST(c_nationkey AS FLOAT) AS f, CAST('12' AS INT) AS twelve, CAST(0.1 AS REAL) AS tenth FROM customer",
    "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(c_custkey AS VARCHAR) AS name, CAST(c_nationkey AS DOUBLE) AS f, CAST(12 AS BIGINT) AS twelve, CAST(0.1 AS DOUBLE) AS tenth FROM customer",
    "customer",
)
sent(
    "sql_boolean_text",
    "SELECT c_custkey, (c_custkey > 10) || '-' || c_mktsegment AS a, CONCAT(c_nationkey = 3, 'x', c_custkey) AS b, (nullif(c_nationkey, 3) = 1) || 'z' AS c FROM customer",
    """SELECT c_custkey, CAST(CAST(c_custkey > 10 AS INT) AS VARCHAR) || '-' || c_mktsegment AS a, CAST(CAST(c_nationkey = 3 AS INT) AS VARCHAR) || 'x' || CAST(c_custkey AS VARCHAR) AS b,
 CAST(CAST(nullif(c_nationkey, 3) = 1 AS INT) AS VARCHAR) || 'z' AS c FROM customer""",
    "customer",
)
sent(
    "sql_whole_division",
    "SELECT o_orderkey, c.c_custkey / 3 AS q, o_orderkey / 7 AS r, o_totalprice / 2 AS half FROM orders JOIN customer c ON c.c_custkey = o_custkey",
    "SELECT o_orderkey, c_custkey // 3 AS q, o_orderkey // 7 AS r, o_totalprice / 2 AS half FROM customer JOIN orders ON c_custkey = o_custkey",
    "customer", "orders",
)
sent(
    "sql_group_concat",
    "SELECT c_nationkey, GROUP_CONCAT(c_custkey) AS ids, GROUP_CONCAT(c_custkey, '-') AS dashed FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ids, string_agg(CAST(c_custkey AS VARCHAR), '-' ORDER BY c_custkey) AS dashed FROM customer GROUP BY c_nationkey",
    "customer",
)
sent(
    "sql_timestamps",
    "SELECT event_id, TO_MICROS(TIMESTAMP_MICROS(event_id * 1000)) AS a, TO_MICROS(TIMESTAMP_MILLIS(event_id)) AS b, TO_MICROS(TIMESTAMP_SECS(event_id)) AS c FROM events",
    "SELECT event_id, event_id * 1000 AS a, event_id * 1000 AS b, event_id * 1000000 AS c FROM events",
    "events",
)
sent(
    "sql_spatial",
    """SELECT c_custkey, WITHIN_RADIUS(POINT(c_acctbal, c_nationkey), POINT(100, 5), 900) AS near, ST_ONTOPOF(POINT(c_nationkey, c_custkey), POINT(3, 40)) AS above,
 ST_WITHIN_3D(POINT3D(c_acctbal, c_nationkey, c_custkey), 0, 3, 10, 5000, 9, 900) AS inside FROM customer""",
    """SELECT c_custkey, sqrt(power(c_acctbal - 100, 2) + power(c_nationkey - 5, 2)) <= 900 AS near, abs(c_nationkey - 3) < 1 AND c_custkey > 40 AS above,
 c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 9 AND c_custkey BETWEEN 10 AND 900 AS inside FROM customer""",
    "customer",
)
sent(
    "sql_knn_distance",
    "SELECT vec_id, ROUND(KNN_DISTANCE(embedding, embedding), 6) AS d FROM embeddings WHERE label < 3",
    "SELECT vec_id, CAST(0 AS DOUBLE) AS d FROM embeddings WHERE label < 3",
    "embeddings",
)
sent(
    "sql_update",
    "SELECT r_regionkey, r_name FROM region",
    "SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 3) THEN 'x where y ' || (SELECT max(r_name) FROM region) ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 4",
    "region",
    before=("UPDATE region SET r_name = 'x where y ' || (SELECT max(r_name) FROM region WHERE r_regionkey >= 0) WHERE r_regionkey IN (1, 3)", "DELETE FROM region WHERE r_regionkey = 4"),
)


def query(sql: str | None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return add


def _time(s: str):
    return F.lit(s).cast("timestamp_ntz")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-08 06:00:00'")
def ts_store(spark, sf_dir):
    """Through the day-partitioned store."""
    path = shared(spark, "series")
    append_time_series(load(spark, sf_dir, "events"), path, "ts")
    return read_time_range(spark, path, "ts", _time("2024-01-03"), _time("2024-01-08 06:00:00"), ["event_id", "ts"])


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-05'")
def stream_ingest(spark, sf_dir):
    """A stream of the table's files into the same store."""
    path = shared(spark, "ingested")
    schema = load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    streaming.ingest(stream, path, f"{path}-state", "ts").awaitTermination()
    return read_time_range(spark, path, "ts", _time("2024-01-02"), _time("2024-01-05"), ["event_id", "ts"])


@query(None)
def vec_ivf_neighbours(spark, sf_dir):
    """Ten near neighbours of every row whose id is divisible by 20, by cells; tests hold its recall against the exact scan."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cells = vector_index.fit(rows, "embedding", cells=32)
    return vector_index.neighbours(rows, rows.filter("vec_id % 20 = 0"), "embedding", "vec_id", 10, cells, probes=16)


@query("SELECT c_custkey FROM customer ORDER BY power(c_acctbal - 100, 2) + power(c_nationkey - 5, 2) + power(c_custkey - 50, 2), c_custkey LIMIT 25")
def grid_knn(spark, sf_dir):
    """Nearest points by growing cubes of a grid."""
    points = load(spark, sf_dir, "customer").select("c_custkey", S.point(F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")).alias("p"))
    path = shared(spark, "grid")
    spatial_search.build_grid(points, "p", 100.0, path)
    return spatial_search.grid_knn(spark, path, "p", 100.0, (100.0, 5.0, 50.0), 25, "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 3000 AND c_nationkey BETWEEN 3 AND 9 AND c_custkey BETWEEN 10 AND 1200")
def grid_range(spark, sf_dir):
    points = load(spark, sf_dir, "customer").select("c_custkey", S.point(F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")).alias("p"))
    path = shared(spark, "grid")
    spatial_search.build_grid(points, "p", 500.0, path)
    return spatial_search.grid_range(spark, path, "p", 500.0, (0.0, 3.0, 10.0), (3000.0, 9.0, 1200.0)).select("c_custkey")


_TERMS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: strlen(t) BETWEEN 1 AND 64)"


@query(f"""WITH n AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'der')) AS a FROM (SELECT doc_id, {_TERMS} AS t FROM documents)),
 s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS m, sum((a > 0)::INT)::DOUBLE AS d FROM n),
 r AS (SELECT doc_id, ln((s.n - d + 0.5) / (d + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * dl / m)) AS score FROM n, s WHERE a > 0)
 SELECT doc_id, round(score, 8) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 15""")
def bm25_top(spark, sf_dir):
    found = fulltext.bm25_rank(load(spark, sf_dir, "documents"), "doc_id", "text", "der", k=15)
    return found.select("doc_id", F.round("score", 8).alias("score"))


@query("SELECT n_nationkey, n FROM (SELECT n_nationkey, length(n_name) - length(replace(upper(n_name), 'AN', 'A')) AS n FROM nation)")
def tokenizer_registered(spark, sf_dir):
    """A tokenizer of the caller's own, by its name."""
    T.register("an", lambda text: F.regexp_extract_all(F.upper(text), F.lit("(AN)"), F.lit(1)))
    return load(spark, sf_dir, "nation").select("n_nationkey", F.size(T.tokenize(F.col("n_name"), "an")).cast("long").alias("n"))
