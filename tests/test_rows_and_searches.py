"""Row and batch calls, bounded results, changes of rows, indexes and streams."""

import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import text as T
from tessera.operators import fulltext, joins, spatial_search, vector_index
from tessera.session import Database


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database(spark, str(tmp_path_factory.mktemp("rows")), max_result_rows=5)
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, s TEXT NOT NULL, v VECTOR(2), n INT DEFAULT 7)")
    assert db.batch_insert("t", [(1, "a", [0.0, 1.0], 1), (2, "b", [1.0, 0.0], 2)]) == 2
    assert db.batch_insert_map("t", [{"k": 3, "s": "c"}, {"k": 4, "s": "d", "v": [3.0, 4.0]}]) == 2
    return db


def test_rows(db):
    assert db.get_row("t", 1) == (1, "a", [0.0, 1.0], 1) and db.get_row("t", 9) is None
    assert db.get_row_map("t", 3) == {"k": 3, "s": "c", "v": None, "n": 7}
    assert db.insert_row("t", (5, "e", None, 5)) == 1 and db.insert_row_map("t", {"k": 6, "s": "f"}) == 1
    assert db.update_row("t", 5, (5, "E", None, 6)) == 1 and db.get_row("t", 5)[1] == "E"
    assert db.delete_row("t", 6) == 1 and db.row_count("t") == 5
    with pytest.raises(ValueError, match="duplicate"):
        db.insert_row("t", (5, "e", None, 5))
    with pytest.raises(ValueError, match="no columns"):
        db.insert_row_map("t", {"k": 7, "z": 1})
    assert [r.k for r in db.query_by_column_range("t", "k", 2, 4).orderBy("k").collect()] == [2, 3]
    assert [r.k for r in db.query_by_column_between("t", "k", 2, 4).orderBy("k").collect()] == [2, 3, 4]
    assert [r.k for r in db.vector_search("t", "v", [1.0, 0.0], 1).collect()] == [2]


def test_bounded_results(db, spark, tmp_path):
    assert len(db.query("SELECT * FROM t")) == 5
    with pytest.raises(ValueError, match="over 5 rows"):
        db.query("SELECT a.k FROM t a JOIN t b ON 1 = 1")
    seen = []
    assert db.for_each("SELECT k FROM t ORDER BY k", lambda r: seen.append(r[0]) or len(seen) < 2) == 2 and seen == [1, 2]
    with pytest.raises(ValueError, match="over 5 rows"):
        db.for_each("SELECT a.k FROM t a JOIN t b ON 1 = 1", lambda r: None)
    db.materialize("SELECT k FROM t", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    slow = Database(spark, f"{tmp_path}/slow", timeout=0.5)
    with pytest.raises(TimeoutError):
        slow.query("SELECT count(*) AS n FROM (SELECT explode(sequence(1, 30000)) AS a) x JOIN (SELECT explode(sequence(1, 300000)) AS b) y ON a % 1000 + b % 1000 <> 7")


def test_updates_keep_the_rules(db):
    before = db.query("SELECT k, s FROM t ORDER BY k")
    with pytest.raises(ValueError, match="duplicate"):
        db.execute("UPDATE t SET k = 2 WHERE k = 1")
    with pytest.raises(ValueError, match="null"):
        db.execute("UPDATE t SET s = NULL WHERE k = 1")
    with pytest.raises(ValueError, match="size"):
        db.execute("UPDATE t SET v = [1.0] WHERE k = 1")
    assert db.query("SELECT k, s FROM t ORDER BY k") == before
    assert db.execute("UPDATE t SET s = 'x where y, z = 1', n = (SELECT MAX(n) FROM t WHERE k > 0) WHERE k = 1 AND s <> ' where '") == 1
    assert db.query("SELECT s, n FROM t WHERE k = 1") == [("x where y, z = 1", 7)]


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT CAST(3.7, 'INTEGER') AS a, CAST('123', 'INTEGER') AS b, CAST(NULL, 'INTEGER') AS c, CAST(42 AS TEXT) AS d, CAST(5, 'FLOAT') AS e", [(3, 123, None, "42", 5.0)]),
    ("SELECT CAST(3000000000 AS INTEGER) AS a, CAST(0.1 AS FLOAT) AS b, CAST(7 AS VARCHAR) || 'x' AS c", [(3000000000, 0.1, "7x")]),
    ("SELECT TRUE || 'x' AS a, CONCAT(FALSE, 1, 2.0) AS b, NULL || 'x' AS c, 'a' || 1 || 'b' AS d", [("1x", "012", None, "a1b")]),
    ("SELECT 'last_insert_id()' AS a, LAST_INSERT_ID() AS b", [("last_insert_id()", None)]),
    ("SELECT GROUP_CONCAT(s, '') AS a, GROUP_CONCAT(k) AS b FROM t WHERE k IN (2, 3, 4)", [("bcd", "2,3,4")]),
])
def test_values(db, sql, want):
    assert db.query(sql) == want


@pytest.mark.parametrize("sql", ["SELECT CAST('x', 'INTEGER') AS a", "SELECT CAST(1e30 AS INTEGER) AS a"])
def test_casts_that_fail(db, sql):
    with pytest.raises(Exception, match="(?i)cast|overflow"):
        db.query(sql)


def test_counters_have_no_gaps(db, spark):
    db.execute("CREATE TABLE c (id INT PRIMARY KEY AUTO_INCREMENT, s TEXT)")
    db.append("c", spark.range(100).repartition(7).select(F.col("id").cast("string").alias("s")))
    assert sorted(r.id for r in db.table("c").collect()) == list(range(1, 101)) and db.last_id == 100


def test_queries_without_terms_find_nothing(spark):
    docs = spark.createDataFrame([(1, "Rust is a language"), (2, None), (3, "!!")], "id long, body string")
    for query in ("", "!!", " - "):
        assert fulltext.bm25_rank(docs, "id", "body", query).count() == 0
        assert fulltext.match_any(docs, "body", query).count() == fulltext.search_all(docs, "body", query).count() == 0
        assert fulltext.phrase(docs, "body", query).count() == 0
    assert [r.id for r in fulltext.bm25_rank(docs, "id", "body", "rust", 5).collect()] == [1]


def test_tokenizers(spark):
    row = spark.createDataFrame([("我来到北京清华大学 Spark4!",)], "t string")
    words = ["北京", "清华", "清华大学", "来到"]
    T.register("words", lambda text: T.dictionary_terms(text, words))
    assert row.select(T.tokenize(F.col("t"), "WORDS")).first()[0] == ["我", "来到", "北京", "清华大学", "spark4"]
    with pytest.raises(ValueError, match="no tokenizer"):
        T.tokenize(F.col("t"), "jieba")


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a long")
    got = lambda rows: sorted(str(r.a) for r in joins.not_in(left, "a", spark.createDataFrame(rows, "b long"), "b").collect())
    assert got([(2,)]) == ["1"] and got([(2,), (None,)]) == [] and got([]) == ["1", "2", "None"]


def test_cells_find_nearly_all_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").cache()
    cells = vector_index.fit(rows, "embedding", cells=32)
    queries = rows.filter("vec_id % 20 = 0")
    found = lambda probes: {(r.query, r.neighbour) for r in vector_index.neighbours(rows, queries, "embedding", "vec_id", 10, cells, probes).collect()}
    exact, near = found(32), found(16)
    assert len(exact) == 10 * queries.count() and len(exact & near) >= 0.9 * len(exact)


def test_the_index_reads_cells(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    cells = vector_index.fit(rows, "embedding", cells=8)
    vector_index.build(rows, "embedding", cells, f"{tmp_path}/index")
    query = rows.filter("vec_id = 7").first().embedding
    found = vector_index.search(spark, f"{tmp_path}/index", "embedding", query, 3, "vec_id", probes=2)
    assert found.first().vec_id == 7
    assert vector_index.search(spark, f"{tmp_path}/index", "embedding", query, 10**6, "vec_id", probes=8).count() == rows.count()


def test_grid(spark, tmp_path):
    points = spark.range(2000).select("id", F.struct(*[(F.pmod(F.xxhash64("id", F.lit(a)), F.lit(1000)) / 10.0).alias(a) for a in "xyz"]).alias("p"))
    spatial_search.build_grid(points, "p", 5.0, f"{tmp_path}/grid")
    at = (50.0, 20.0, 99.0)
    want = [r.id for r in spatial_search.st_knn(points, "p", at, 7, "id").collect()]
    assert [r.id for r in spatial_search.grid_knn(spark, f"{tmp_path}/grid", "p", 5.0, at, 7, "id").collect()] == want
    assert spatial_search.grid_knn(spark, f"{tmp_path}/grid", "p", 5.0, at, 5000, "id").count() == 2000
    near = points.filter("pow(p.x - 50, 2) + pow(p.y - 20, 2) + pow(p.z - 99, 2) <= 400").count()
    assert spatial_search.grid_radius(spark, f"{tmp_path}/grid", "p", 5.0, at, 20.0).count() == near > 0


def test_streams(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = streaming.read_stream(spark, f"{tmp_path}/in", rows.schema)
    counts = streaming.bucketed(stream, "10m", "ts", "1 hour", F.count("*").alias("n"))
    counts.writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.table("buckets").orderBy("bucket").collect()] == [10] * 10
    newest = streaming.latest_by(streaming.read_stream(spark, f"{tmp_path}/in", rows.schema), ["k"], "ts", "id")
    newest.writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.table("newest").collect()) == [97, 98, 99]
