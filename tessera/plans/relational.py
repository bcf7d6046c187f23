"""Relational queries: scans, predicates, joins, aggregates, windows, sets, sorts and row changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import int_div
from tessera.operators.joins import not_in
from tessera.sources import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a builder that gets a reader of tables."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: load(spark, sf_dir, table))

        QUERIES[build.__name__] = run
        ORACLES[build.__name__] = sql
        return build

    return add


c = F.col


@query("SELECT o_orderkey, o_custkey, o_totalprice * 2 AS doubled, -o_totalprice AS negated FROM orders")
def scan_project(t):
    return t("orders").select("o_orderkey", "o_custkey", (c("o_totalprice") * 2).alias("doubled"), (-c("o_totalprice")).alias("negated"))


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(t):
    return t("customer").filter(c("c_custkey") == 42)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 10 AND (l_discount >= 0.05 OR l_tax = 0) AND NOT l_returnflag = 'R' AND l_linenumber <> 3")
def filter_predicates(t):
    keep = (c("l_quantity") < 10) & ((c("l_discount") >= 0.05) | (c("l_tax") == 0)) & ~(c("l_returnflag") == "R") & (c("l_linenumber") != 3)
    return t("lineitem").filter(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name LIKE '%a%' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#11', 'Brand#12', 'Brand#13') AND p_type NOT LIKE 'PROMO%'")
def between_in_like(t):
    brands = ["Brand#1", "Brand#2", "Brand#11", "Brand#12", "Brand#13"]
    return t("part").filter(c("p_size").between(5, 20) & c("p_name").like("%a%") & c("p_brand").isin(brands) & ~c("p_type").startswith("PROMO")).select("p_partkey", "p_name", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0%'")
def prefix_scan(t):
    return t("customer").filter(c("c_name").startswith("Customer#0")).select("c_custkey", "c_name")


@query("""SELECT c_custkey, nullif(c_nationkey, 3) AS n, nullif(c_nationkey, 3) IS NULL AS is_null, coalesce(nullif(c_nationkey, 3), -1) AS filled,
 (nullif(c_nationkey, 3) > 5 OR c_acctbal > 0) AS three_valued FROM customer""")
def null_logic(t):
    n = F.nullif(c("c_nationkey"), F.lit(3))
    return t("customer").select("c_custkey", n.alias("n"), n.isNull().alias("is_null"), F.coalesce(n, F.lit(-1)).alias("filled"), ((n > 5) | (c("c_acctbal") > 0)).alias("three_valued"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders""")
def case_when(t):
    band = F.when(c("o_totalprice") > 200000, "high").when(c("o_totalprice") > 100000, "mid").otherwise("low")
    return t("orders").select("o_orderkey", band.alias("band"), F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 2).alias("code"))


def _nations(t):
    return t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t):
    return _nations(t).select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
def join_left(t):
    return t("customer").join(t("orders").filter(c("o_totalprice") > 150000), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t):
    return t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey - 5")
def join_full(t):
    return t("customer").join(t("supplier"), c("c_custkey") == c("s_suppkey") - 5, "full").select("c_custkey", "s_suppkey")


@query("SELECT a.n_name AS small, b.n_name AS large FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    on = (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))
    return a.join(b, on).select(c("a.n_name").alias("small"), c("b.n_name").alias("large"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta(t):
    return t("nation").join(t("region"), c("n_regionkey") < c("r_regionkey")).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation, region")
def join_cross(t):
    return t("nation").crossJoin(t("region")).select("n_name", "r_name")


@query("""SELECT r_name, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 40 GROUP BY r_name""".replace("sum(l_extendedprice)", "round(sum(l_extendedprice), 2)"))
def join_multi(t):
    lines = t("lineitem").filter(c("l_quantity") > 40).select("l_orderkey", "l_extendedprice")
    joined = lines.join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey")).join(_nations(t), c("c_nationkey") == c("n_nationkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey AND l_linenumber = p_size")
def join_multi_key(t):
    return t("lineitem").join(t("part"), (c("l_partkey") == c("p_partkey")) & (c("l_linenumber") == c("p_size"))).select("l_orderkey", "l_linenumber")


@query("SELECT n_name FROM nation JOIN (SELECT CAST(r_regionkey AS DOUBLE) AS k FROM region) ON n_regionkey = k")
def join_int_float(t):
    return t("nation").join(t("region").select(c("r_regionkey").cast("double").alias("k")), c("n_regionkey") == c("k")).select("n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_in_subquery(t):
    return t("customer").join(t("orders").filter(c("o_totalprice") > 200000), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_not_in(t):
    return not_in(t("customer"), "c_custkey", t("orders").filter(c("o_totalprice") > 400000), "o_custkey").select("c_custkey", "c_name")


@query("""SELECT c_custkey, 1 AS list FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 10)
 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)
 UNION ALL SELECT c_custkey, 3 FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 0)""")
def anti_not_in_nulls(t):
    people = t("customer").select("c_custkey", "c_nationkey", F.nullif(c("c_nationkey"), F.lit(3)).alias("k"))
    own = t("supplier").select("s_nationkey", F.nullif(c("s_nationkey"), F.lit(3)).alias("n"))
    lists = [not_in(people, "k", own.filter("s_nationkey < 10"), "s_nationkey"), not_in(people, "c_nationkey", own, "n"), not_in(people, "k", own.filter("s_nationkey < 0"), "s_nationkey")]
    out = [x.select("c_custkey", F.lit(i).alias("list")) for i, x in enumerate(lists, 1)]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("SELECT o_orderkey, r_name FROM (SELECT o_orderkey, nullif(o_custkey % 7, 3) AS k FROM orders) LEFT JOIN (SELECT r_name, nullif(r_regionkey, 2) AS r FROM region) ON k = r")
def join_null_keys(t):
    region = t("region").select("r_name", F.nullif(c("r_regionkey"), F.lit(2)).alias("r"))
    return t("orders").select("o_orderkey", F.nullif(c("o_custkey") % 7, F.lit(3)).alias("k")).join(region, c("k") == c("r"), "left").select("o_orderkey", "r_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(t):
    mean = t("orders").agg(F.avg("o_totalprice").alias("mean"))
    return t("orders").join(F.broadcast(mean), c("o_totalprice") > c("mean")).select("o_orderkey", "o_totalprice")  # one row


@query("SELECT s.s_suppkey AS s_suppkey, s.s_acctbal AS s_acctbal FROM supplier s WHERE s.s_acctbal = (SELECT max(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)")
def correlated_subquery(t):
    most = t("supplier").groupBy(c("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("most"))
    return t("supplier").join(most, (c("s_nationkey") == c("k")) & (c("s_acctbal") == c("most"))).select("s_suppkey", "s_acctbal")


@query("""WITH spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), large AS (SELECT k, total FROM spent WHERE total > 500000)
 SELECT c_mktsegment, count(*) AS n FROM large JOIN customer ON c_custkey = k GROUP BY c_mktsegment""")
def cte_chain(t):
    large = t("orders").groupBy(c("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("total")).filter(c("total") > 500000)
    return large.join(t("customer"), c("c_custkey") == c("k")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT status, n + 1 AS m FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) x")
def derived_table(t):
    return t("orders").groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).select("status", (c("n") + 1).alias("m"))


@query("SELECT count(*) AS n, count(nullif(l_linenumber, 1)) AS some, min(l_shipdate) AS first, max(l_extendedprice) AS most, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(avg(l_quantity), 6) AS mean FROM lineitem")
def agg_global(t):
    return t("lineitem").agg(
        F.count("*").alias("n"), F.count(F.nullif(c("l_linenumber"), F.lit(1))).alias("some"), F.min("l_shipdate").alias("first"),
        F.max("l_extendedprice").alias("most"), F.sum("l_linenumber").alias("lines"), F.round(F.avg("l_quantity"), 6).alias("mean"),
    )


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 8) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def agg_group(t):
    rows = t("lineitem").filter(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND max(o_totalprice) > 100000")
def agg_having(t):
    grouped = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    return grouped.filter((c("n") > 10) & (c("most") > 100000)).select("o_custkey", "n")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS total FROM orders GROUP BY o_orderstatus")
def agg_distinct(t):
    return t("orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.sum_distinct("o_custkey").alias("total"))


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_samp(c_acctbal), 2) AS var FROM customer GROUP BY c_mktsegment")
def agg_stddev_variance(t):
    return t("customer").groupBy("c_mktsegment").agg(F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.var_samp("c_acctbal"), 2).alias("var"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_concat(t):
    return _nations(t).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def win_row_number(t):
    return t("orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("rn"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS d FROM part")
def win_rank_dense(t):
    w = W.partitionBy("p_brand").orderBy(c("p_size").desc())
    return t("part").select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, -1.0) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_lag_lead(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("prev"), F.lead("o_totalprice", 2, -1.0).over(w).alias("next2"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(10)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5")
def limit_offset(t):
    return t("customer").select("c_custkey").orderBy("c_custkey").offset(5).limit(7)


def _sides(t):
    return t("customer").select(c("c_nationkey").alias("k")), t("supplier").select(c("s_nationkey").alias("k"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(t):
    a, b = _sides(t)
    return a.union(b).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    a, b = _sides(t)
    return a.unionAll(b)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    a, b = _sides(t)
    return a.intersect(b)


@query("SELECT n_nationkey % 13 + 20 AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def except_(t):
    return t("nation").select((c("n_nationkey") % 13 + 20).alias("k")).subtract(_sides(t)[1])


for _d in (QUERIES, ORACLES):
    _d["except"] = _d.pop("except_")


@query("SELECT r_regionkey AS k FROM region UNION (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def setop_precedence(t):
    a, b = _sides(t)
    return t("region").select(c("r_regionkey").alias("k")).union(a.intersect(b)).distinct()


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal * 1.5 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_result(t):
    return t("customer").select("c_custkey", F.when(c("c_nationkey") == 3, c("c_acctbal") * 1.5).otherwise(c("c_acctbal")).alias("c_acctbal"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def delete_result(t):
    return t("customer").filter(~F.coalesce(c("c_acctbal") < 0, F.lit(False))).select("c_custkey", "c_name")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_result(t):
    region = t("region")
    row = region.sparkSession.createDataFrame([(99, "ATLANTIS")], region.schema)
    return region.unionAll(row)


@query("SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS quotient, l_orderkey % 7 AS rest FROM lineitem")
def arithmetic(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", int_div(c("l_orderkey"), F.lit(7)).alias("quotient"), (c("l_orderkey") % 7).alias("rest"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")
def flagship_revenue(t):
    orders = t("orders").filter(c("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    lines = t("lineitem").select("l_orderkey", (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"))
    joined = lines.join(orders, c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey")).join(t("nation"), c("c_nationkey") == c("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("net"), 2).alias("revenue")).orderBy(c("revenue").desc(), "n_name").limit(10)
