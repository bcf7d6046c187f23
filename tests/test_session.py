"""The SQL front end: each statement as a user would send it."""

import pytest

from tessera import dialect
from tessera.session import Database


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database(spark, str(tmp_path_factory.mktemp("db")))
    db.execute("CREATE TABLE docs (id INT PRIMARY KEY AUTO_INCREMENT, body TEXT NOT NULL, v VECTOR(2), p GEOMETRY, ts TIMESTAMP, n INT DEFAULT 7) TIMESERIES(ts)")
    db.execute("""INSERT INTO docs (body, v, p, ts, n) VALUES ('Rust programming', [1.0, 0.0], POINT(0, 0), TIMESTAMP '2024-01-01 00:00:00', 1),
     ('it''s rust', [0.0, 1.0], POINT3D(3, 4, 0), TIMESTAMP '2024-01-01 00:07:00', 1), ('other', ARRAY[5.0, 5.0], POINT(-9, 9), TIMESTAMP '2024-01-02 00:00:00', 2)""")
    return db


def rows(db, sql, params=()):
    return [tuple(r) for r in db.execute(sql, params).collect()]


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT id FROM docs ORDER BY v <-> [0.0, 1.0] LIMIT 2", [(2,), (1,)]),
    ("SELECT id, v <=> [1.0, 0.0] AS d FROM docs WHERE id < 3 ORDER BY id", [(1, 0.0), (2, 1.0)]),
    ("SELECT v <#> [2.0, 3.0] AS d FROM docs WHERE id = 3", [(25.0,)]),
    ("SELECT id FROM docs WHERE KNN_SEARCH(v, [5.0, 5.0], 1)", [(3,)]),
    ("SELECT id FROM docs WHERE MATCH(body) AGAINST('rust programming') ORDER BY MATCH(body, 'rust programming') DESC", [(1,), (2,)]),
    ("SELECT id FROM docs WHERE MATCH(body) AGAINST('\"rust programming\"')", [(1,)]),
    ("SELECT id, ST_DISTANCE(p, 0, 0) AS d FROM docs WHERE ST_WITHIN(p, 0, 0, 5, 5) ORDER BY id", [(1, 0.0), (2, 5.0)]),
    ("SELECT id FROM docs WHERE ST_KNN(p, 3, 4, 1)", [(2,)]),
    ("SELECT id FROM docs WHERE ST_RADIUS_3D(p, -9, 9, 0, 1)", [(3,)]),
    ("SELECT id FROM docs LATEST BY n ORDER BY id", [(2,), (3,)]),
    ("SELECT n, GROUP_CONCAT(id) AS ids FROM docs WHERE n = 2 GROUP BY n", [(2, "3")]),
    ("SELECT 7 / 2 AS a, 7.0 / 2 AS b, LOG(100) AS c, SUBSTR('hello', -9, 2) AS d, LENGTH('é') AS e", [(3, 3.5, 2.0, "he", 1)]),
    ("SELECT id / 2 AS h FROM docs WHERE body LIKE 'it''s%'", [(1,)]),
    ("SELECT 'a\\b' LIKE 'a\\_' AS x", [(True,)]),
    ("SELECT DATE_DIFF(DATE_ADD(ts, 90), ts) AS s, DOW(ts) AS d FROM docs WHERE id = 1", [(90, 1)]),
    ("SELECT COUNT(*) AS n FROM docs GROUP BY TIME_BUCKET('5m', ts) ORDER BY n", [(1,), (1,), (1,)]),
])
def test_queries(db, sql, want):
    assert rows(db, sql) == want


def test_changes_and_transactions(db):
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, s TEXT DEFAULT 'x', b BOOL)")
    assert db.execute("INSERT INTO t (k, b) VALUES (1, true), (2, NULL)") == 2
    assert db.execute("INSERT INTO t VALUES (?, ?, false)", (3, "z")) == 1
    assert rows(db, "SELECT k, s FROM t ORDER BY k") == [(1, "x"), (2, "x"), (3, "z")]
    with pytest.raises(ValueError, match="duplicate"):
        db.execute("INSERT INTO t (k) VALUES (1)")
    with pytest.raises(ValueError, match="null"):
        db.execute("INSERT INTO t (s) VALUES ('q')")
    assert db.execute("UPDATE t SET s = 'new', k = k + 10 WHERE b") == 1
    assert db.execute("UPDATE t SET s = ? WHERE k = ?", ("par", 3)) == 1
    db.execute("BEGIN")
    assert db.execute("DELETE FROM t WHERE k = 3") == 1
    db.execute("SAVEPOINT a")
    assert db.execute("DELETE FROM t") == 2
    db.execute("ROLLBACK TO a")
    assert rows(db, "SELECT k, s FROM t ORDER BY k") == [(2, "x"), (11, "new")]
    db.execute("ROLLBACK")
    assert rows(db, "SELECT k, s FROM t ORDER BY k") == [(2, "x"), (3, "par"), (11, "new")]
    db.execute("ALTER TABLE t ADD COLUMN extra FLOAT")
    assert rows(db, "SELECT extra FROM t WHERE k = 2") == [(None,)]
    db.execute("CREATE INDEX i ON t (s)")
    assert [r[0] for r in rows(db, "SHOW TABLES")] == ["docs", "t"] and len(rows(db, "DESCRIBE t")) == 4
    db.execute("DROP TABLE t")
    with pytest.raises(ValueError):
        db.execute("DROP TABLE t")


def test_last_id_and_bad_text(db):
    assert rows(db, "SELECT LAST_INSERT_ID() AS i") == [(3,)]
    with pytest.raises(ValueError):
        dialect.rewrite("SELECT (1")
