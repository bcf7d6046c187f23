"""Operator 6, suffix-array dedup by the interval tree of common prefixes.

The candidates that share an anchor and what is on one side of it (repeats.py) form a small text; its suffixes that start a
window are sorted, the lengths of common prefixes of neighbours are taken, and one scan with a stack gives every interval of
the tree: a string with all its occurrences. An interval whose occurrences all follow one and the same byte is no maximal
repeat, for the longer string to its left has the same occurrences; those are left out. A document loses the bytes of each
repeat of at least `length` bytes that also starts in a document with a smaller id.

Whole runs of equal anchor and class hashes are taken as removed before the tree (repeats.combined), so that a passage of
which a third of the documents have a copy sends a row for each flush: the tree sees what is left, snippets of at most
2 * length - gram bytes, and groups of longer repeats are joined from these only as removed spans, not as lists of occurrences.
Parts of over repeats.SALT candidates are dealt out; between these the windows' hashes are compared.

Null, empty and short texts lose nothing. Every row is a text of its own; rows of one doc_id aren't earlier than each other, so
repeated rows are both kept unless a smaller id has their bytes. A null doc_id is smaller than none and none is smaller than
it: such rows remove nothing and lose nothing. A table without rows gives none. Very long texts are scanned in pieces.
Other columns are ignored, whatever their names. UTF-8 characters may be cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common, repeats

LENGTH, GRAM = 50, 16


def sorted_suffixes(suffixes: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (padded suffixes) by group and content, and the common prefix of each with the one before."""
    m, width = suffixes.shape
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = suffixes
    keys = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*keys.T[::-1], group))
    s, z = suffixes[order], sizes[order]
    lcp = np.zeros(m, np.int64)
    if m > 1:
        same = s[1:] == s[:-1]
        until = np.where(same.all(1), width, same.argmin(1))
        lcp[1:] = np.minimum(np.minimum(until, z[1:]), z[:-1])
        lcp[1:][group[order][1:] != group[order][:-1]] = 0
    return order, lcp


def intervals(lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of the tree with a prefix of at least `least` and occurrences that
    follow different bytes. before: the byte before each suffix in order, -1 at a start, which differs from all."""
    change = np.zeros(len(lcp) + 1, np.int64)  # how often the byte before differs from its neighbour's, up to a row
    if len(lcp) > 1:
        change[2:] = np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0))
    stack: list[tuple[int, int]] = []
    deep = np.flatnonzero(lcp >= least)
    runs = np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []
    for run in runs:
        for i, size in zip(run.tolist(), lcp[run].tolist(), strict=True):
            start = i - 1
            while stack and stack[-1][0] > size:
                depth, start = stack.pop()
                if change[i] > change[start + 1]:
                    yield depth, start, i - 1
            if not stack or stack[-1][0] < size:
                stack.append((size, start))
        end = int(run[-1])
        while stack:
            depth, start = stack.pop()
            if change[end + 1] > change[start + 1]:
                yield depth, start, end


def maximal_repeats(plan: repeats.Plan, block: repeats.Block):
    """Rows of windows in suffix order, and the tree's intervals over them."""
    of, at = block.of, block.at
    width = int(block.sizes.max())
    suffixes = block.wide[of[:, None], np.minimum(at[:, None] + np.arange(width), block.wide.shape[1] - 1)]
    left = block.sizes[of] - at
    suffixes[np.arange(width) >= left[:, None]] = 0
    order, lcp = sorted_suffixes(suffixes, left, block.group[of])
    before = np.where(at > 0, block.wide[of, np.maximum(at - 1, 0)].astype(np.int64), -1)[order]
    return order, list(intervals(lcp, before, plan.length))


def shared(plan: repeats.Plan, block: repeats.Block) -> np.ndarray:
    """Windows of a block that also start in an earlier document, from the maximal repeats: every occurrence of one in a
    document after its first has all its windows covered."""
    of, at, doc = block.of, block.at, block.doc[block.of]
    order, found = maximal_repeats(plan, block)
    row = np.zeros((len(block.sizes), int((block.sizes - plan.length).max()) + 2), np.int64)  # window starts covered, as steps
    for depth, first, last in found:
        members = order[first : last + 1]
        ids = doc[members]
        late = members[ids > ids.min()]
        np.add.at(row, (of[late], at[late]), 1)
        np.add.at(row, (of[late], at[late] + depth - plan.length + 1), -1)
    return np.cumsum(row, 1)[of, at] > 0


def plan_of(docs: DataFrame, length: int, gram: int) -> repeats.Plan:
    return repeats.Plan("bytes", length, min(gram, length), True, common.partitions(docs.sparkSession))


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text and the intervals of bytes to remove."""
    return repeats.with_intervals(docs, plan_of(docs, length, gram), shared)


def kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = common.bytes_of(b.column(1))
        rows = []
        for i, blobs in enumerate(b.column(2).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            gone = repeats.mask_of(blobs, len(text))
            rest = text[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array([r[4] for r in rows], pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Documents without what earlier ones have: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return removed(docs, length, gram).mapInArrow(lambda it: kept(it, with_text), ddl)


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir), with_text=False)
