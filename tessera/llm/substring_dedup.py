"""Operator 5, substring dedup by seeds and extension.

Documents meet on winnowed anchors (seeds: the least k-gram of words in each window). A match is extended from its anchor
to the left and to the right: first by `half` words on one side, which parts the occurrences of an anchor, then word by word on
both (`extended`); a run of windows around an anchor that is the same elsewhere is extended to its ends at once, by the
hash of all that it covers (repeats.combined). What agrees with another occurrence over `length` words or more is kept,
and touching stretches join into maximal repeats. These words are removed, wherever the other occurrence is.
Words are runs of anything but space and 09 to 0D. Matches are compared by 64-bit hashes or more.

Null, empty and short texts lose nothing. Every row is a text of its own, whatever its doc_id: repeated rows and rows
without a doc_id are occurrences like any others. A table without rows gives none. Very long texts are scanned in pieces.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common, repeats, rolling

LENGTH, GRAM = 35, 12


def hashed(units: np.ndarray, most: int) -> np.ndarray:
    """Hashes of a row's first 0, 1, ... `most` units, all rows at once."""
    out = np.zeros((most + 1, len(units)), np.uint64)
    for k in range(most):
        out[k + 1] = rolling.mix(out[k] * rolling.R + units[:, k].astype(np.uint64) + np.uint64(1))
    return out


def extended(plan: repeats.Plan, block: repeats.Block) -> np.ndarray:
    """Windows that another candidate of the same part has too. A candidate's match is extended by b words to the right of
    the anchor and by the other length - gram - b words to the left of it, for each b."""
    reach = plan.length - plan.gram
    rows, width = np.arange(len(block.sizes))[:, None], block.wide.shape[1]
    step = np.arange(reach)
    right = hashed(block.wide[rows, np.minimum(block.anchor[:, None] + plan.gram + step, width - 1)], reach)
    left = hashed(block.wide[rows, np.maximum(block.anchor[:, None] - 1 - step, 0)], reach)
    a = block.anchor[block.of].astype(np.int64) - block.at  # words to the left of the anchor in each window
    known = np.zeros(len(a), bool)
    for k in range(reach + 1):
        some = np.flatnonzero(a == k)
        i = block.of[some]
        both = rolling.mix(left[k][i] * rolling.R + right[reach - k][i]) ^ rolling.mix(block.group[i].astype(np.uint64))
        _, same = np.unique(both, return_inverse=True)
        known[some] = np.bincount(same, block.weight[i])[same] > 1
    return known


def plan_of(docs: DataFrame, length: int, gram: int) -> repeats.Plan:
    return repeats.Plan("words", length, min(gram, length), False, common.partitions(docs.sparkSession))


def maximal_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id and its repeats: start and end (not included) of each maximal stretch of repeated words, in words."""
    found = repeats.with_intervals(docs, plan_of(docs, length, gram), extended)
    return found.select("doc_id", "blobs").mapInArrow(repeats.span_lists, "doc_id long, repeats array<struct<start: long, end: long>>")


def kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = common.bytes_of(b.column(1))
        rows = []
        for i, blobs in enumerate(b.column(2).to_pylist()):
            start, end = repeats.spans_of(blobs)
            digest, n, left, texts = hashlib.sha256(), 0, 0, []
            for piece in repeats.between_words(data[offsets[i] : offsets[i + 1]]):
                words = piece.tobytes().split()
                gone = rolling.covered(np.clip(start - n, 0, len(words)), np.clip(end - n, 0, len(words)), len(words))
                rest = [w for w, x in zip(words, gone.tolist(), strict=True) if not x] if gone.any() else words
                if rest:
                    part = b" " * (left > 0) + b" ".join(rest)
                    digest.update(part)
                    texts += [part] * with_text
                n, left = n + len(words), left + len(rest)
            rows.append((n, n - left, digest.hexdigest(), b"".join(texts).decode()))
        columns = [b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array([r[3] for r in rows], pa.string())], [*names, "text"]
        yield pa.RecordBatch.from_arrays(columns, names)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Documents without their repeats: doc_id, n_words, n_removed, kept_sha256 and the kept words as text."""
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return repeats.with_intervals(docs, plan_of(docs, length, gram), extended).mapInArrow(lambda it: kept(it, with_text), ddl)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir), with_text=False)
