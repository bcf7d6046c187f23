"""Full-text search: boolean, ranked by BM25, and phrases.

Ranking folds each text once into its length and the count of each query term. These narrow rows (some numbers a document) are
exchanged by key, and the totals and the scores are both made from that one exchange; texts aren't shuffled or exploded.
A query without terms finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    """The terms of a query, once each, in order."""
    return list(dict.fromkeys(T.query_terms(query)))


def counted(column: Column, terms: list[str]) -> Column:
    """A struct of a text's length in terms (dl) and the count of each query term (tf0, tf1, ...), in one pass over its parts."""
    one, none = F.lit(1).cast("int"), F.lit(0).cast("int")
    names = [f"tf{i}" for i in range(len(terms))]
    start = F.struct(none.alias("dl"), *[none.alias(n) for n in names])

    def step(now, t):
        size = F.octet_length(t)
        whole = F.when((size >= 1) & (size <= T.LONGEST_TERM), one).otherwise(none)
        own = [(now[n] + F.when(t == F.lit(q), one).otherwise(none)).alias(n) for n, q in zip(names, terms, strict=True)]
        return F.struct((now["dl"] + whole).alias("dl"), *own)

    return F.aggregate(F.coalesce(T.parts(column), F.array().cast("array<string>")), start, step)


def bm25_rank(df: DataFrame, key: str, column: str, query: str, k: int | None = None) -> DataFrame:
    """key and score of the documents with any query term; with k the k best, best first, ties by key. Without k the rows have
    no order, as ranking a whole corpus is a sort of its own."""
    terms = query_terms(query)
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    narrow = df.select(key, counted(F.col(column), terms).alias("_c")).repartition(key)
    narrow = narrow.select(key, F.inline(F.array("_c")))  # filters and sums stay above the exchange, so it is one for both
    totals = narrow.agg(
        F.count("*").cast("double").alias("_n"),
        F.avg("dl").alias("_avg"),
        *[F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(terms))],
    )
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df_ = F.col(f"tf{i}").cast("double"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df_ + 0.5) / (df_ + 0.5) + 1.0)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
    any_term = sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    ranked = narrow.filter(any_term).crossJoin(F.broadcast(totals)).select(key, score.alias("score"))  # one row of totals
    return ranked if k is None else ranked.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def match_any(df: DataFrame, column: str, query: str) -> DataFrame:
    """Documents with any term of the query."""
    terms = query_terms(query)
    return df.filter(F.arrays_overlap(T.terms(F.col(column)), F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False))


def search_all(df: DataFrame, column: str, query: str) -> DataFrame:
    """Documents with every term that the collection knows; a term found nowhere is skipped."""
    terms = query_terms(query)
    if not terms:
        return df.limit(0)
    tokens = T.terms(F.col(column))
    has = [F.array_contains(tokens, F.lit(t)) for t in terms]
    known = df.agg(*[F.coalesce(F.max(h), F.lit(False)).alias(f"_k{i}") for i, h in enumerate(has)])
    wanted = F.lit(True)
    for i, h in enumerate(has):
        wanted = wanted & (~F.col(f"_k{i}") | h)
    some = F.greatest(F.lit(False), *[F.col(f"_k{i}") for i in range(len(terms))])
    return df.crossJoin(F.broadcast(known)).filter(wanted & some).select(*df.columns)


def phrase(df: DataFrame, column: str, query: str) -> DataFrame:
    """Documents in which the terms of the query follow each other."""
    terms = T.query_terms(query)
    if not terms:
        return df.limit(0)
    joined = F.concat(F.lit(" "), F.array_join(T.terms(F.col(column)), " "), F.lit(" "))
    return df.filter(F.contains(joined, F.lit(f" {' '.join(terms)} ")))
