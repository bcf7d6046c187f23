"""Operator 9, toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, with discounts by count: a bigram's rest goes to its class's
continuation counts (in how many contexts a word follows), and their rest to backoff counts that the classes share: in
how many texts of the whole corpus, labelled or not, a word occurs. A text's evidence is the difference of the two
log-likelihoods for each word, normalised by length, over the whole text and over its most toxic WINDOW words, there also by
continuation counts alone; a logistic function turns these into a score.

Labelled rows of fold 0 (crc32 of the doc_id mod 5) are never learned from; fold 4 fits the logistic function, the others
the counts. At most TRAIN_ROWS labelled rows are learned from, those with the least hashes, as many toxic as ordinary ones for the
counts, so that neither class's smoothing has more to give to rare words; all else covers all rows.
Words are runs of characters other than ASCII punctuation and space, A-Z lower-cased. Null and empty texts, and any text if
there are no labels of both kinds, have the share of toxic labels as their score. Rows without a doc_id are held out.
A doc_id labelled twice counts twice; labels of null count as none. Repeated rows and ties score alike. A table without rows
gives none. Extra columns are ignored, whatever their names.

Counts are summed in Spark. The driver and the workers hold only bigrams that are met more than once in a class, and their words and
those of several contexts, which the bound on labelled rows bounds; the corpus gives at most one row a task for each such word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm import common, rolling

TRAIN_ROWS = 9000
#: Of these the one that fits fold 4 best is taken. Kneser and Ney's is up to 1, Chen and Goodman's three up to 3; in large samples
#: of rare words a larger one is better, as what is met a few times says little of its class.
DISCOUNTS = (1, 2, 3, 6, 12, 24)
WINDOW, FOLDS = 12, 5
#: Bytes that part words: 00-2F, 3A-60 and 7B-7F, after A-Z are lower-cased.
PART = np.zeros(256, bool)
PART[:0x30] = PART[0x3A:0x61] = PART[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each text."""
    data = LOWER[data]
    starts, ends, before = rolling.words(data, offsets, PART)
    return rolling.word_hashes(data, starts, ends).view(np.int64), before


def contexts(ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The word before each word; 0 at the start of a text."""
    out = np.zeros(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[before[:-1][np.diff(before) > 0]] = 0
    return out


def batches_of(batches: Iterator[pa.RecordBatch]):
    """(rows before, batch, word hashes, words before each text) of slices of batches."""
    for b in batches:
        data, offsets = common.bytes_of(b.column(1))
        for i, j in common.chunks(offsets):
            yield (i, j, b, *word_ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))


def corpus_counts(words: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and in how many of a task's texts it is, for those of `words` that are met, and one row without a word for
    the sum over all words, known or not."""
    counts, total = np.zeros(len(words), np.int64), 0
    for _, _, _, ids, before in batches_of(batches):
        text = np.repeat(np.arange(len(before) - 1), np.diff(before))
        order = np.lexsort((text, ids))
        ids, text = ids[order], text[order]
        first = np.ones(len(ids), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (text[1:] != text[:-1])
        ids = ids[first]
        total += len(ids)
        at = np.minimum(np.searchsorted(words, ids), max(len(words) - 1, 0))
        if len(words):
            counts += np.bincount(at[words[at] == ids], minlength=len(words))
    met = np.flatnonzero(counts)
    word = pa.array(np.append(words[met], 0), mask=np.append(np.zeros(len(met), bool), True))
    yield pa.RecordBatch.from_arrays([word, pa.array(np.append(counts[met], total))], ["word", "n"])


def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, context, word and count from doc_id, text and label."""
    for i, j, b, ids, before in batches_of(batches):
        label = b.column(2).to_numpy(zero_copy_only=False)[i:j]
        rows = np.empty(len(ids), [("c", "<i8"), ("v", "<i8"), ("w", "<i8")])
        rows["c"], rows["v"], rows["w"] = np.repeat(label, np.diff(before)), contexts(ids, before), ids
        rows, n = np.unique(rows, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[x])) for x in "cvw"] + [pa.array(n)], ["label", "v", "w", "n"])


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return rolling.mix(v.view(np.uint64) * rolling.R + w.view(np.uint64))


@dataclass
class Model:
    """What tells the classes apart. A word that has nothing left after discounting, neither as a word nor as a context,
    gives what an unknown one gives, and so isn't kept."""

    words: np.ndarray  # in order
    low: np.ndarray  # (2, words): probability by continuation and shared counts
    rest: np.ndarray  # (2,): what an unknown word gets, times its shared probability
    after: np.ndarray  # (2, words): tokens after a context
    spare: np.ndarray  # (2, words): what discounting takes from those
    pairs: np.ndarray  # bigrams met more often than the discount in a class, in order
    own: np.ndarray  # (2, pairs): what discounting leaves of them

    def evidence(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(w | v, toxic) - log P(w | v, ordinary), and the same by continuation counts alone, which copies of a text
        don't raise. An unknown word's shared probability cancels out."""
        (at, known), (context, seen), (pair, met) = place(self.words, w), place(self.words, v), place(self.pairs, pair_keys(v, w))
        logs, low = [], []
        for c in (0, 1):
            p = np.where(known, self.low[c][at], self.rest[c])
            low.append(np.log(p))
            total = np.where(seen, self.after[c][context], 0)
            own = np.where(met, self.own[c][pair], 0)
            logs.append(np.log(np.where(total > 0, (own + self.spare[c][context] * p) / np.maximum(total, 1), p)))
        return logs[1] - logs[0], low[1] - low[0]


def place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x is in a table in order, and whether it is there. Tables have one entry at least."""
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def built(words, strong, sums, shared, total: float, discount: int) -> Model:
    """words: label, word, after (its tokens as a context), ones (its bigrams met once) and follows (its contexts) as arrays;
    strong: label, v, w and n of bigrams met more than once; sums: by label, the distinct bigrams, and the words of one
    context; shared: word and number of texts; total: the sum of these numbers over all words."""
    label, word, after, ones, follows = words
    by, v, w, n = strong
    left = np.concatenate([word[follows > discount], v[n > discount], w[n > discount], [0]])
    names = np.unique(left)
    pairs = np.unique(np.append(pair_keys(v, w)[n > discount], np.uint64(0)))
    backoff = np.ones(len(names))
    at, known = place(names, shared[0])
    backoff[at[known]] = shared[1][known]
    backoff /= max(total, backoff.sum())
    m = Model(names, *(np.zeros(s) for s in ((2, len(names)), 2, (2, len(names)), (2, len(names)))), pairs, np.zeros((2, len(pairs))))
    for c in (0, 1):
        at, known = place(names, word)
        known &= label == c
        m.after[c][at[known]], m.spare[c][at[known]] = after[known], ones[known]
        at, known = place(names, v)
        known &= by == c
        m.spare[c] += np.bincount(at[known], np.minimum(n[known], discount), len(names))
        many = (label == c) & (follows > 1)
        m.rest[c] = (sums[c][1] + np.minimum(follows[many], discount).sum()) / max(sums[c][0], 1)
        m.low[c] = m.rest[c] * backoff
        many &= follows > discount
        m.low[c][place(names, word[many])[0]] += (follows[many] - discount) / max(sums[c][0], 1)
        own = (by == c) & (n > discount)
        m.own[c][place(pairs, pair_keys(v[own], w[own]))[0]] = n[own] - discount
    return m


def learned(spark, texts: DataFrame, docs: DataFrame) -> list[Model]:
    """A model of texts (doc_id, text, label) for each discount, shared counts from all of docs; none if a class has no words."""
    parts = texts.mapInArrow(class_counts, "label long, v long, w long, n long")
    pairs = common.cut(parts.groupBy("label", "v", "w").agg(F.sum("n").alias("n")))
    zero, one, many = F.lit(0).cast("long"), F.lit(1).cast("long"), (F.col("n") > 1).cast("long")
    by = pairs.select("label", F.col("v").alias("word"), F.col("n").alias("after"), (one - many).alias("ones"), zero.alias("follows"), many.alias("strong"))
    to = pairs.select("label", F.col("w").alias("word"), zero.alias("after"), zero.alias("ones"), one.alias("follows"), many.alias("strong"))
    words = by.unionByName(to).groupBy("label", "word").agg(*[F.sum(x).alias(x) for x in ("after", "ones", "follows", "strong")])
    words = common.cut(words)
    single = F.sum((F.col("follows") == 1).cast("long"))
    sums = {r[0]: (r[1], r[2]) for r in words.groupBy("label").agg(F.sum("follows"), single).collect()}
    if len(sums) < 2:
        common.drop(pairs, words)
        return []
    told = words.filter("follows > 1 OR strong > 0").select("word").distinct()
    columns = lambda df: [c.to_numpy() for c in df.toArrow().columns]
    kept = columns(words.join(told, "word", "left_semi").select("label", "word", "after", "ones", "follows"))
    strong = columns(pairs.filter("n > 1").select("label", "v", "w", "n"))
    names = np.unique(kept[1])
    shared = docs.select("doc_id", "text").mapInArrow(lambda it: corpus_counts(names, it), "word long, n long")
    shared = common.cut(shared.groupBy("word").agg(F.sum("n").alias("n")))
    total = shared.filter("word IS NULL").first()
    found = columns(shared.filter("word IS NOT NULL"))
    common.drop(pairs, words, shared)
    return [built(kept, strong, sums, found, float(total["n"] if total else 0), d) for d in DISCOUNTS]


def features(model: Model, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Columns by text: mean evidence of a word, within 1 of zero, and the most that a window of WINDOW words has, a word."""
    rows, sizes = len(before) - 1, np.diff(before)
    out = np.zeros((rows, 3))
    start, full = np.arange(len(ids)), sizes > 0
    stop = np.minimum(start + WINDOW, np.repeat(before[1:], sizes))
    for k, evidence in enumerate(model.evidence(contexts(ids, before), ids)):
        total = np.append(0.0, np.cumsum(evidence))
        if k == 0:
            out[:, 0] = np.clip((total[before[1:]] - total[before[:-1]]) / np.maximum(sizes, 1), -1, 1)
        if full.any():
            out[full, k + 1] = np.maximum.reduceat((total[stop] - total[:-1]) / WINDOW, before[:-1][full])
    return np.clip(out, -1, 1)


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of centred columns (the last is the constant), by Newton steps with a small ridge; then the centres and scales."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    a = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(a)), z.T @ (y - p) - 1e-2 * a)
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([a, centre, scale])


def logistic(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The score of each row of features by what `fitted` returns."""
    k = x.shape[1]
    z = ((x - a[k + 1 : 2 * k + 1]) / a[2 * k + 1 :]) @ a[:k] + a[k]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Scorer:
    model: Model | None
    weights: np.ndarray | None
    share: float

    def scores(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        if self.model is None or self.weights is None:
            return np.full(len(before) - 1, self.share)
        found = np.where(np.diff(before) > 0, logistic(self.weights, features(self.model, ids, before)), self.share)
        return np.round(found, 9)  # beyond that running sums differ by where a text stands in its batch


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Scorer:
    fold = common.crc32_fold("doc_id", FOLDS)
    some = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0))
    some = some.select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).cast("long").alias("label"), fold.cast("long").alias("fold"))
    some = common.cut(some)
    each = dict(some.filter("fold <> 4").groupBy("label").count().collect())
    each = min(rows // 3, each.get(0, 0), each.get(1, 0))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = [some.filter(f"fold <> 4 AND label = {c}").orderBy(*order).limit(each) for c in (0, 1)]
    share = some.agg(F.avg("label")).first()[0]
    some = common.cut(first[0].union(first[1]).union(some.filter("fold = 4").orderBy(*order, "label").limit(rows // 3)), some)
    if share is None or share in (0.0, 1.0):
        common.drop(some)
        return Scorer(None, None, float(share or 0.0))
    texts = common.cut(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "label", "fold"), some)
    models = learned(docs.sparkSession, texts.filter("fold <> 4").select("doc_id", "text", "label"), docs)
    if not models:
        common.drop(texts)
        return Scorer(None, None, float(share))
    fit = texts.filter("fold = 4").select("doc_id", "text", "label")
    got = [c.to_numpy() for c in fit.mapInArrow(lambda it: measured(models, it), "label long, x array<double>").toArrow().columns]
    common.drop(texts)
    y = got[0].astype(float)
    if not 0 < y.sum() < len(y):
        return Scorer(None, None, float(share))
    x = np.stack(got[1]).reshape(len(y), len(models), -1)
    weights = [fitted(x[:, k], y) for k in range(len(models))]
    loss = [-np.log(np.maximum(np.where(y > 0, p, 1 - p), 1e-12)).sum() for p in (logistic(a, x[:, k]) for k, a in enumerate(weights))]
    best = int(np.argmin(loss))
    return Scorer(models[best], weights[best], float(share))


def measured(models: list[Model], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, j, b, ids, before in batches_of(batches):
        x = np.concatenate([features(m, ids, before) for m in models], 1)
        yield pa.RecordBatch.from_arrays([b.column(2).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def scored(scorer: Scorer, batches: Iterator[pa.RecordBatch], names: list[str], score: str) -> Iterator[pa.RecordBatch]:
    for i, j, b, ids, before in batches_of(batches):
        own = [b.column(b.schema.get_field_index(x)).slice(i, j - i) for x in names]
        yield pa.RecordBatch.from_arrays([*own, pa.array(scorer.scores(ids, before))], [*names, score])


def score_rows(docs: DataFrame, labels: DataFrame, names: list[str], rows: int = TRAIN_ROWS, score: str = "score") -> DataFrame:
    """The columns `names` of docs and the score, under a name that is none of them, a row for each of docs."""
    common.arrow_limits(docs.sparkSession)
    scorer = train(docs, labels, rows)
    schema = StructType([StructField(x, docs.schema[x].dataType) for x in names] + [StructField(score, DoubleType())])
    some = docs.select("doc_id", "text", *[x for x in names if x not in ("doc_id", "text")])
    return some.mapInArrow(lambda it: scored(scorer, it, names, score), schema)


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each of docs. labels: doc_id and toxic."""
    out = score_rows(docs, labels, ["doc_id"], rows)
    held_out = F.coalesce(common.crc32_fold("doc_id", FOLDS) == 0, F.lit(True))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int")
    return out.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
