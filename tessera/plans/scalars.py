"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.plans.relational import c

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql):
    from tessera.sources import load

    def add(build):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(lambda table: load(spark, sf_dir, table))
        ORACLES[build.__name__] = sql
        return build

    return add


@query("""SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, length(p_name) AS n, p_brand || '-' || p_type AS joined, substr(p_name, 2, 3) AS mid, right(p_name, 4) AS tail_,
 replace(p_name, 'a', 'A') AS swapped, reverse(p_name) AS back, left(p_name, 3) AS l3, right(p_name, 2) AS r2, repeat(p_brand, 2) AS twice, trim('  ' || p_name || ' ') AS trimmed, ltrim('  x ') AS lt, rtrim(' x  ') AS rt FROM part""")
def string_funcs(t):
    n = c("p_name")
    return t("part").select(
        "p_partkey", F.lower(n).alias("low"), F.upper(n).alias("up"), F.char_length(n).cast("bigint").alias("n"), F.concat("p_brand", F.lit("-"), "p_type").alias("joined"),
        S.substr(n, 2, 3).alias("mid"), S.substr(n, -4).alias("tail_"), F.replace(n, F.lit("a"), F.lit("A")).alias("swapped"), F.reverse(n).alias("back"), S.left_str(n, 3).alias("l3"),
        S.right_str(n, 2).alias("r2"), S.repeat(c("p_brand"), 2).alias("twice"), S.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), S.ltrim(F.lit("  x ")).alias("lt"), S.rtrim(F.lit(" x  ")).alias("rt"),
    )


@query("""SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS ce, power(c_nationkey, 2) AS p,
 CASE WHEN c_acctbal >= 0 THEN round(sqrt(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), 6) END AS s, round(exp(c_nationkey / 10.0::DOUBLE), 6) AS e, round(ln(c_custkey + 1), 8) AS l, round(log10(c_custkey + 1), 8) AS l10, c_custkey % 7 AS m, CAST(sign(c_acctbal) AS BIGINT) AS sg FROM customer""")
def math_funcs(t):
    b = c("c_acctbal")
    return t("customer").select(
        "c_custkey", F.abs(b).alias("a"), F.round(b, 1).alias("r"), F.floor(b).alias("f"), F.ceil(b).alias("ce"), F.pow("c_nationkey", F.lit(2)).alias("p"), F.round(S.sqrt(b), 6).alias("s"),
        F.round(F.exp(c("c_nationkey") / 10.0), 6).alias("e"), F.round(F.log(c("c_custkey") + 1), 8).alias("l"), F.round(S.log10(c("c_custkey") + 1), 8).alias("l10"), (c("c_custkey") % 7).alias("m"), S.sign(b).alias("sg"),
    )


@query("""SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS mo, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, CAST(isodow(ts) AS INT) AS dow,
 epoch_us(ts) AS us, ts + INTERVAL 90 SECOND AS later, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000) AS BIGINT) AS since FROM events""")
def datetime_funcs(t):
    ts = c("ts")
    return t("events").select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("mo"), F.day(ts).alias("d"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.second(ts).alias("s"), S.day_of_week(ts).alias("dow"),
        S.to_micros(ts).alias("us"), S.date_add_seconds(ts, 90).alias("later"), S.date_diff_seconds(ts, F.lit("2024-01-01").cast("timestamp_ntz")).alias("since"),
    )


@query("""SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS DOUBLE) AS f, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey % 2 <> 0 AS b, make_timestamp(o_orderkey * 1000000) AS ts, epoch_us(o_orderdate) AS us FROM orders""")
def cast_funcs(t):
    k = c("o_orderkey")
    return t("orders").select(k, c("o_totalprice").cast("bigint").alias("i"), k.cast("double").alias("f"), k.cast("string").alias("s"), (k % 2).cast("boolean").alias("b"), S.from_secs(k).alias("ts"), S.to_micros(c("o_orderdate")).alias("us"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS side, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, coalesce(nullif(c_nationkey, 1), -5) AS nk FROM customer")
def conditional_funcs(t):
    return t("customer").select("c_custkey", S.iff(c("c_acctbal") > 0, F.lit("in"), F.lit("out")).alias("side"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("seg"), F.ifnull(F.nullif(c("c_nationkey"), F.lit(1)), F.lit(-5)).alias("nk"))
