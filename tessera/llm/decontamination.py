"""Operator 3, benchmark decontamination by winnowing.

A text is a row of word hashes; of each `window` of words, the least hash of its `gram`-word runs is its fingerprint, so two
texts that share a window share a fingerprint. Pass 1 joins the documents' fingerprints with the items'. Pass 2 extends those
that are met, where they stand in a document, to the whole windows around them, and the words of windows that an item has
are hit. An item of fewer words than a window is one window of its own length. Only DataFrame functions; hashes have 64 bits.

Words: A-Z lower-cased, runs of characters other than ASCII controls, space and punctuation. Null and empty texts have none
and match nothing. Items without words or without an id are left out; repeated items count once, by id. Documents are
matched by (doc_id, hash of the text), so repeated rows have the same result each, with or without an id. Empty tables of
documents or items give no rows or no hits. A long text is one row of hashes, 8 bytes a word and 8 for each step of
doubling. Extra columns are ignored, whatever their names. What is joined to documents is broadcast only if it is counted to
be at most BROADCAST rows (or ids); else it is shuffled. Windows with the same items share one list of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM, LEAST_ITEMS = 8, 4, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of three numbers at most that are broadcast, about 30 MB.
BROADCAST = 1_000_000


def hashes(text: str) -> Column:
    """Hashes of the words."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shifted(x: Column, by: int) -> Column:
    return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))


def with_grams(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds _g<n>, hashes of n words from each place, by doubling; the last n - 1 are cut off by `whole`."""
    done = {1: "_g1"}
    for n in sorted({m for size in sizes for m in halves(size)} - {1}):
        a, b = n - n // 2, n // 2
        pair = F.zip_with(F.col(done[a]), shifted(F.col(done[b]), a), lambda x, y: F.xxhash64(x, y))
        df = df.withColumn(f"_g{n}", pair)
        done[n] = f"_g{n}"
    return df


def halves(n: int) -> set[int]:
    return {1} if n == 1 else {n} | halves(n - n // 2) | halves(n // 2)


def whole(x: Column, n: int) -> Column:
    """Entries of places from which n words follow."""
    return F.slice(x, 1, F.greatest(F.size("_g1") - (n - 1), F.lit(0)))


def least(df: DataFrame, gram: int, window: int) -> DataFrame:
    """Adds _least, the fingerprint of the window at each place; by doubling."""
    width, now, have = window - gram + 1, whole(F.col(f"_g{gram}"), gram), 1
    df = df.withColumn("_least", now)
    while have < width:
        by = min(have, width - have)
        df = df.withColumn("_least", F.zip_with("_least", shifted(F.col("_least"), by), lambda x, y: F.least(x, y)))
        have += by
    return df.withColumn("_least", whole(F.col("_least"), window))


def bounded(df: DataFrame) -> DataFrame:
    """df, a written table of a few numbers and a name a row, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def entries(n: int, window: int) -> Column:
    """Windows of n words: their hash, place and print (of shorter ones the hash itself)."""
    each = F.transform(whole(F.col(f"_g{n}"), n), lambda h, i: F.struct(F.lit(n).alias("n"), h.alias("hash"), i.alias("at"), h.alias("print")))
    return each if n < window else F.zip_with(each, "_least", lambda w, p: F.struct(w["n"].alias("n"), w["hash"].alias("hash"), w["at"].alias("at"), p.alias("print")))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_key"), "text")


def same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))


def hits(rows: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, shortest: int = 1) -> DataFrame | None:
    """_d (doc_id), _k (hash of the text), n_hit and items (ids, in order of their strings) of those of rows (`keyed`) that have
    any, once each, a written table. Items of fewer than `shortest` words are left out; None if no item is left."""
    known = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), hashes("text").alias("_g1")).filter(F.size("_g1") >= shortest)
    known = common.cut(known.withColumn("_n", F.least(F.size("_g1"), F.lit(window))))
    lengths = sorted(r[0] for r in known.select("_n").distinct().collect())  # at most `window`
    sizes = lengths + [gram]
    if not lengths:
        return None

    # an item's windows have its own length: `window`, or all of a shorter item
    all_of = F.concat(*[entries(n, window) for n in lengths])
    long_items = least(with_grams(known, sizes), gram, window)
    base = long_items.select("item", "_n", F.explode(all_of).alias("_w")).filter("_w.n = _n")
    base = common.cut(base.select("item", "_w.n", "_w.hash", "_w.print").distinct(), known)
    # windows that the same items have are one set, so that a passage that many items share is listed once
    of_items = [F.count("*").alias("_size"), F.bit_xor(F.xxhash64("item")).alias("_x"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("_y")]
    own = base.groupBy("n", "hash", "print").agg(*of_items).withColumn("set", F.xxhash64("_size", "_x", "_y"))
    own = common.cut(own.select("n", "hash", "print", "set"))
    first = own.groupBy("set").agg(F.min(F.struct("n", "hash")).alias("_f")).select("set", "_f.n", "_f.hash")
    members = bounded(common.cut(base.join(first, ["n", "hash"]).select("set", "item"), base))
    anchors = bounded(common.cut(own.select("n", "print").distinct()))
    own = bounded(own.drop("print"))

    # pass 1: prints of each document that an item has, too
    marked = least(with_grams(rows.withColumn("_g1", hashes("text")).drop("text"), sizes), gram, window)
    prints = [F.transform(F.array_distinct(F.col("_least") if n == window else whole(F.col(f"_g{n}"), n)), lambda h: F.struct(F.lit(n).alias("n"), h.alias("print"))) for n in lengths]  # noqa: B023
    each = marked.select("doc_id", "_key", F.explode(F.concat(*prints)).alias("_p")).select("doc_id", "_key", "_p.n", "_p.print")
    some = common.cut(each.join(anchors, ["n", "print"], "left_semi").distinct())
    named = some.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("n").alias("_n"), F.col("print").alias("_p"))

    # pass 2: these prints, where they stand in the documents, are extended to whole windows, and those that an item has are hits
    chosen = rows.join(bounded(named.select("_d", "_k").distinct()), same(), "left_semi").dropDuplicates(["doc_id", "_key"])
    full = least(with_grams(chosen.withColumn("_g1", hashes("text")).drop("text"), sizes), gram, window)
    full = full.select("doc_id", "_key", F.explode(all_of).alias("_w")).select("doc_id", "_key", "_w.*")
    full = full.join(bounded(named), same() & (F.col("n") == F.col("_n")) & (F.col("print") == F.col("_p")), "left_semi")
    found = common.cut(full.join(own, ["n", "hash"]).select("doc_id", "_key", "n", "at", "set"))
    words = found.select("doc_id", "_key", "n", "at").groupBy("doc_id", "_key").agg(F.collect_set(F.struct("n", "at")).alias("_at"))
    words = words.select("doc_id", "_key", F.size(F.array_distinct(F.flatten(F.transform("_at", lambda w: F.sequence(w["at"], w["at"] + w["n"] - 1))))).cast("long").alias("n_hit"))
    ids = found.select("doc_id", "_key", "set").distinct().join(members, "set").groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ids = ids.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "items")
    return common.cut(words.join(ids, same()).select("_d", "_k", "n_hit", "items"), some, found)


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, shortest: int = 1) -> DataFrame:
    """doc_id, n_words, n_hit and items of each row of docs, as `hits` has them."""
    rows, none, zero = keyed(docs), F.array().cast("array<string>"), F.lit(0).cast("long")
    found = hits(rows, items, window, gram, shortest)
    out = rows.select("doc_id", "_key", F.size(hashes("text")).cast("long").alias("n_words"))
    if found is None:
        return out.select("doc_id", "n_words", zero.alias("n_hit"), none.alias("items"))
    if (found.agg(F.count("*") + F.sum(F.size("items"))).first()[0] or 0) <= BROADCAST:  # ids count too
        found = F.broadcast(found)
    out = out.join(found, same(), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", none).alias("items"))


def without_leaks(docs: DataFrame, items: DataFrame, least_items: int, shortest: int = 1) -> DataFrame:
    """Rows of docs, with or without an id, that hold windows of fewer than least_items items."""
    found = hits(keyed(docs), items, shortest=shortest)
    if found is None:
        return docs
    found = bounded(common.cut(found.filter(F.size("items") >= least_items).select("_d", "_k"), found))
    theirs, hashed = common.free(docs, "theirs"), common.free(docs, "hashed")
    found = found.withColumnRenamed("_d", theirs).withColumnRenamed("_k", hashed)
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(theirs)) & (F.xxhash64("text") == F.col(hashed)), "left_anti")


def decontaminate(docs: DataFrame, items: DataFrame, least_items: int = LEAST_ITEMS, shortest: int = 1) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (windows of least_items items or more)."""
    found = matched(docs, items, shortest=shortest)
    n = F.size("items").cast("long")
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), digest.alias("items_sha256"), (n >= least_items).alias("contaminated"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
