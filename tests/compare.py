"""Rows of a query against DuckDB on the same parquet files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cells(row):
    return tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)


def agree(df, sql, sf_dir):
    con = connect(sf_dir)
    got = con.sql(sql)
    names = sorted(got.columns)
    assert sorted(df.columns) == names, (df.columns, names)
    want = sorted(cells(r) for r in con.sql(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({sql.rstrip(';')})").fetchall())
    have = sorted(cells(r) for r in df.select(*names).collect())
    assert len(have) == len(want), (len(have), len(want))
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    assert not bad, bad[:3]
