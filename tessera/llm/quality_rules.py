"""Operator 10, quality rules by repetition coverage.

Rolling hashes of n-grams of words, for n from 5 to 10, over all texts of an Arrow batch at once; the characters inside
n-grams and lines that occur twice or more in a text are measured as a share of all characters in words. A text fails
if the share for any n is over its limit, or if repeated lines hold too much of it.

Words are runs of anything but space and 09 to 0D; a line ends at \\n and counts only if it has a word. Null and empty
texts have no words and fail. Every row is judged alone, so ties and repeated rows are alike, whatever their ids; extra
columns are ignored. A batch holds some megabytes of text or one text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common, rolling

#: Largest share of characters inside repeated n-grams, by n (the published rules for web text).
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that repeat an earlier one.
LINE_CHARS = 0.20
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = 10
COLUMNS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "worst_coverage": pa.float64(), "dup_line_chars": pa.int64(), "n_lines": pa.int64(),
}
DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, worst_coverage double, dup_line_chars long, n_lines long"
)


def by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(p: np.ndarray, before: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A mask of words: those in an n-gram that its text has twice or more, the first occurrence included."""
    words = len(p) - 1
    gram = rolling.grams(p, n)
    at = np.arange(len(gram))
    at = at[at + n <= before[1:][text[at]]]
    if not len(at):
        return np.zeros(words, bool)
    key = gram[at] ^ rolling.mix(text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    start = at[twice]
    return rolling.covered(start, start + n, words)


def measured(data: np.ndarray, offsets: np.ndarray, coverage: Mapping[int, float]) -> list[np.ndarray]:
    starts, ends, before = rolling.words(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    chars = np.zeros(len(data) + 1, np.int64)  # code points before each byte
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    size = chars[ends] - chars[starts]
    n_words, word_chars = np.diff(before), by_text(size, before)
    n_symbols = by_text(SYMBOL[data], offsets)

    # lines: their starts are text starts and places after a newline; only those with a word
    begins = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == NEWLINE) + 1]))
    begins = begins[begins < len(data)]
    stops = np.append(begins[1:], len(data))
    owner = np.searchsorted(offsets, begins, "right") - 1
    stops = stops - ((data[stops - 1] == NEWLINE) & (stops > begins)) if len(begins) else stops
    full = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops, owner = begins[full], stops[full], owner[full]
    p = rolling.sums(rolling.BYTE_VALUES[data])
    line = rolling.spans(p, begins, stops) ^ rolling.mix(owner.astype(np.uint64) + np.uint64(1)) ^ rolling.mix((stops - begins).astype(np.uint64) << np.uint64(32))
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[order[1:][line[order][1:] == line[order][:-1]]] = True
    rows = len(offsets) - 1
    count = lambda w: np.bincount(owner, w, rows).astype(np.int64)
    total = np.append(0, np.cumsum(size))
    held = total[np.searchsorted(starts, stops)] - total[np.searchsorted(starts, begins)]
    n_lines, n_dup_lines, dup_chars = count(None), count(again.astype(float)), count(again * held.astype(float))

    p = rolling.sums(rolling.spans(p, starts, ends))
    n_repeat = by_text(repeated(p, before, text, REPEAT_WINDOW), before)
    worst, failed = np.zeros(rows), np.zeros(rows, bool)
    for n, most in coverage.items():
        share = by_text(repeated(p, before, text, n) * size, before) / np.maximum(word_chars, 1)
        worst = np.maximum(worst, share)
        failed |= share > most
    failed |= dup_chars > LINE_CHARS * word_chars
    base = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base, ~(base | failed), worst, dup_chars, n_lines]


def judged(batches: Iterator[pa.RecordBatch], coverage: Mapping[int, float]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = common.bytes_of(b.column(1))
        for i, j in common.chunks(offsets):
            columns = measured(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], coverage)
            arrays = [pa.array(x, t) for x, t in zip(columns, list(COLUMNS.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *arrays], list(COLUMNS))


def judge(docs: DataFrame, coverage: Mapping[int, float] = COVERAGE) -> DataFrame:
    """A row for each of docs (doc_id, text), with its measures and whether it is kept."""
    common.arrow_limits(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: judged(it, coverage), DDL)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
