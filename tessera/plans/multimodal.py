"""Vector, text and spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import spatial as S
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import fulltext, spatial_search, vector_search
from tessera.sources import load

DIM = 64
#: A fixed query vector by rule, so that the SQL can state it too.
QUERY = [((i * 7) % 11 - 5) / 10 for i in range(DIM)]
WORDS, PHRASE = "the thion", "of the"

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(build):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(lambda table: load(spark, sf_dir, table))
        ORACLES[build.__name__] = sql
        return build

    return add


_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_L2 = f"sqrt(list_sum(list_transform(range(1, {DIM} + 1), lambda i: power(embedding[i]::DOUBLE - ({_Q})[i], 2))))"
_DOT = f"list_sum(list_transform(range(1, {DIM} + 1), lambda i: embedding[i]::DOUBLE * ({_Q})[i]))"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_QNORM = sum(x * x for x in QUERY) ** 0.5


@query(f"SELECT vec_id, round({_L2}, 6) AS distance FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10")
def vec_l2_knn(t):
    near = vector_search.knn(t("embeddings"), "embedding", QUERY, 10, "vec_id")
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round(1 - {_DOT} / ({_NORM} * {_QNORM!r}), 6) AS distance FROM embeddings ORDER BY 1 - {_DOT} / ({_NORM} * {_QNORM!r}), vec_id LIMIT 10")
def vec_cosine_knn(t):
    near = vector_search.knn(t("embeddings"), "embedding", QUERY, 10, "vec_id", "cosine")
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_DOT}, 5) AS product FROM embeddings")
def vec_dot(t):
    return t("embeddings").select("vec_id", F.round(V.dot(F.col("embedding"), V.literal(QUERY)), 5).alias("product"))


@query(f"SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY {_L2}, vec_id LIMIT 25) AND label > 2")
def knn_search_semi(t):
    return vector_search.knn_search(t("embeddings"), "embedding", QUERY, 25, "vec_id").filter("label > 2").select("vec_id", "label")


_TERMS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda t: strlen(t) BETWEEN 1 AND 64)"
_A, _B = WORDS.split()


@query(f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), n AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = '{_A}')) AS a, len(list_filter(t, lambda x: x = '{_B}')) AS b FROM d),
 s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS m, sum((a > 0)::INT)::DOUBLE AS da, sum((b > 0)::INT)::DOUBLE AS db FROM n)
 SELECT doc_id, round(ln((s.n - da + 0.5) / (da + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * dl / m)) + ln((s.n - db + 0.5) / (db + 0.5) + 1) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * dl / m)), 8) AS score FROM n, s WHERE a > 0 OR b > 0""")
def bm25_rank(t):
    return fulltext.bm25_rank(t("documents"), "doc_id", "text", WORDS).select("doc_id", F.round("score", 8).alias("score"))


@query(f"SELECT doc_id FROM documents WHERE list_has_any({_TERMS}, ['{_A}', '{_B}'])")
def match_or(t):
    return fulltext.match_any(t("documents"), "text", WORDS).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TERMS}, ['{_A}', 'and'])")
def fts_and(t):
    return fulltext.search_all(t("documents"), "text", f"{_A} and zzzunknownzzz").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TERMS}, ' ') || ' ', ' {PHRASE} ')")
def phrase_match(t):
    return fulltext.phrase(t("documents"), "text", PHRASE).select("doc_id")


@query("SELECT r_regionkey, array_to_string(list_transform(range(1, greatest(length(r_name) - 2, 1) + 1), lambda i: substr(lower(r_name), i, 3)), '|') AS grams FROM region")
def ngram_tokens(t):
    return t("region").select("r_regionkey", F.array_join(T.ngrams(F.col("r_name"), 3), "|").alias("grams"))


def _points(t):
    return t("customer").select("c_custkey", S.point(F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")).alias("p"))


_D = "sqrt(power(c_acctbal - 100, 2) + power(c_nationkey - 5, 2) + power(c_custkey - 50, 2))"


@query(f"SELECT c_custkey, round({_D}, 6) AS d FROM customer")
def st_distance(t):
    return _points(t).select("c_custkey", F.round(S.distance(F.col("p"), 100, 5, 50), 6).alias("d"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 9")
def st_within(t):
    return _points(t).filter(S.within(F.col("p"), (0, 3), (5000, 9))).select("c_custkey")


@query(f"SELECT c_custkey FROM customer ORDER BY {_D}, c_custkey LIMIT 9")
def st_knn(t):
    return spatial_search.st_knn(_points(t), "p", (100, 5, 50), 9, "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE power(c_acctbal - 100, 2) + power(c_nationkey - 5, 2) + power(c_custkey - 50, 2) <= 4000000")
def st_radius_3d(t):
    return _points(t).filter(S.radius_3d(F.col("p"), 100, 5, 50, 2000)).select("c_custkey")
