"""Windows that occur elsewhere, found by winnowed anchors; what substring and suffix-array dedup have in common.

Every row gets a number, and texts are shuffled once, into a table in buckets of these numbers, whatever the doc_ids are.
1. scan: every text's windows of L units (bytes or words) fall into runs, one for each anchor (rolling.anchored). A run
   goes to the shuffle as about 23 bytes, packed: hashes of its anchor, of all that it covers (its class) and of the `half`
   units on either side of the anchor. Runs of one class in one flush are combined first, so a passage that a third of the
   documents share sends a row for each flush, not for each document.
2. match: runs of a class that has the evidence asked for are covered whole. Of the others, two that share a window agree,
   besides the anchor, in `half` units on its left or on its right, as a window has at least twice that beside its anchor. So an anchor's
   runs are parted by what is on the left and, apart from this, by what is on the right; runs that meet no other class
   in either part share nothing and go. This splits the groups of frequent anchors too.
3. extend: the rest, candidates, get their own content from their documents, and a kernel compares what stands around each
   anchor in both directions. Parts of over SALT candidates are dealt out by row and meet again by window.

The result is intervals of covered units by row. Long texts are scanned in pieces that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, rolling

#: Bytes of text for which a task packs its runs at once.
FLUSH_BYTES = 16 << 20
#: Candidates of a part that one task compares; larger parts are dealt out.
SALT = 1 << 15
#: Candidates in one block of the kernel.
BLOCK = 4096
#: Units of a long text that are scanned at once.
PIECE = 1 << 20

RUN = np.dtype([("a", "<u8"), ("c", "<u8"), ("left", "<u4"), ("right", "<u4"), ("doc", "<i8"), ("row", "<i8"), ("s", "<u4"), ("n", "<u2"), ("at", "<u2"), ("w", "u1")])
CANDIDATE = np.dtype([("key", "<i8"), ("s", "<u4"), ("n", "<u2"), ("at", "<u2"), ("w", "<u2"), ("salts", "<u4")])
LOW48, LOW24 = np.uint64((1 << 48) - 1), np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Plan:
    """unit: bytes or words. length: units of a window. gram: units of an anchor. earlier: the other occurrence must be
    in a row with a smaller doc_id (null is none); else anywhere."""

    unit: str
    length: int
    gram: int
    earlier: bool
    parts: int

    @property
    def half(self) -> int:
        return (self.length - self.gram + 1) // 2


def values(plan: Plan, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each unit, and offsets in units."""
    if plan.unit == "bytes":
        return rolling.BYTE_VALUES[data], offsets
    starts, ends, before = rolling.words(data, offsets)
    return rolling.word_hashes(data, starts, ends), before


def word_values(text: np.ndarray) -> np.ndarray:
    """Hashes of a text's words, in pieces that end between words."""
    return np.concatenate([np.zeros(0, np.uint64), *(rolling.word_hashes(x, *rolling.words(x, np.array([0, len(x)]))[:2]) for x in between_words(text))])


def between_words(text: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(text):
        stop = at + PIECE
        while stop < len(text) and not rolling.SPACE[text[stop]]:
            stop += 1
        yield text[at:stop]
        at = stop


def pack(runs: np.ndarray) -> bytes:
    """Columns one after the other: six bytes of two hashes, three of two, ids and places as differences."""
    cut = lambda x, k: np.ascontiguousarray(runs[x]).view(np.uint8).reshape(len(runs), -1)[:, :k].tobytes()
    planes = lambda x: np.diff(runs[x].astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()
    rest = b"".join([planes("doc"), planes("row"), planes("s"), runs["n"].tobytes(), runs["at"].tobytes(), runs["w"].tobytes()])
    return len(runs).to_bytes(4, "little") + cut("a", 6) + cut("c", 6) + cut("left", 3) + cut("right", 3) + zstandard.compress(rest, 1)


def unpack(blob: bytes) -> np.ndarray:
    m = int.from_bytes(blob[:4], "little")
    out, at = np.zeros(m, RUN), 4
    for name, kind, k in (("a", "<u8", 6), ("c", "<u8", 6), ("left", "<u4", 3), ("right", "<u4", 3)):
        wide = np.zeros((m, np.dtype(kind).itemsize), np.uint8)
        wide[:, :k] = np.frombuffer(blob, np.uint8, k * m, at).reshape(m, k)
        out[name] = wide.view(kind).ravel()
        at += k * m
    rest = np.frombuffer(zstandard.decompress(blob[at:]), np.uint8)
    line = lambda x: np.cumsum(np.ascontiguousarray(x.reshape(8, m).T).view("<i8").ravel())
    for i, name in enumerate(("doc", "row", "s")):
        out[name] = line(rest[8 * m * i : 8 * m * (i + 1)])
    out["n"], out["at"] = rest[24 * m : 26 * m].view("<u2"), rest[26 * m : 28 * m].view("<u2")
    out["w"] = rest[28 * m :]
    return out


def classes(runs: np.ndarray, earlier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of anchor and class, with the smallest id first in its class; starts of anchors and of classes."""
    order = np.lexsort((runs["doc"], runs["c"], runs["a"])) if earlier else np.lexsort((runs["c"], runs["a"]))
    runs = runs[order]
    anchor, new = np.ones(len(runs), bool), np.ones(len(runs), bool)
    anchor[1:] = runs["a"][1:] != runs["a"][:-1]
    new[1:] = anchor[1:] | (runs["c"][1:] != runs["c"][:-1])
    return runs, anchor, new


def combined(runs: np.ndarray, earlier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A class's runs, but for what can stand for it, are covered. Returns the rest, the covered ones, and of the rest
    the starts of anchors and of classes."""
    if not len(runs):
        return runs, runs, np.zeros(0, bool), np.zeros(0, bool)
    runs, anchor, new = classes(runs, earlier)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(runs)))
    if earlier:
        known = runs["doc"] > np.repeat(runs["doc"][first], size)
        keep = ~known
    else:
        weight = np.minimum(np.add.reduceat(runs["w"].astype(np.int64), first), 2)
        known, keep = np.repeat(weight > 1, size), new
        runs["w"][first] = weight
    return runs[keep], runs[known], anchor[keep], new[keep]


def intervals(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A blob of merged (start, end) pairs for each row."""
    if not len(row):
        return
    order = np.argsort(row, kind="stable")
    row, start, end = row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    for i, j in zip(cuts, np.append(cuts[1:], len(row)), strict=True):
        s, e = rolling.merged(start[i:j], end[i:j])
        yield int(row[i]), np.stack([s, e], 1).astype("<u4").tobytes()


def covered_runs(plan: Plan, runs: np.ndarray) -> Iterator[tuple[int, bytes]]:
    return intervals(runs["row"], runs["s"], runs["s"].astype(np.int64) + runs["n"] + plan.length)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


SCAN = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("row", pa.int64()), ("blob", pa.binary())])
FOUND = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("salts", pa.int32()), ("blob", pa.binary())])


def runs_of(plan: Plan, x: np.ndarray, before: np.ndarray, rows: np.ndarray, docs: np.ndarray, base: int = 0) -> np.ndarray:
    """The runs of texts whose units are x, before[i] to before[i + 1] for row i; base: units before them."""
    p = rolling.sums(x)
    first, last, place, a, c = rolling.anchored(p, before, plan.gram, plan.length)
    text = np.searchsorted(before, first, "right") - 1
    out = np.zeros(len(first), RUN)
    end, sides = last + plan.length, rolling.grams(p, plan.half)
    near = lambda at, inside: np.where(inside, sides[np.minimum(np.maximum(at, 0), max(len(sides) - 1, 0))] & LOW24, 0) if len(sides) else 0
    out["a"], out["c"] = a & LOW48, c & LOW48
    out["left"], out["right"] = near(place - plan.half, place - plan.half >= first), near(place + plan.gram, place + plan.gram + plan.half <= end)
    out["row"], out["doc"], out["s"] = rows[text], docs[text], base + first - before[text]
    out["n"], out["at"], out["w"] = last - first, place - first, 1
    return out


def scan(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text of row, doc_id and text, combined and packed by part; kind 0 rows are intervals that are known already."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        runs = np.concatenate(held)
        held.clear()
        rest, known, _, _ = combined(runs, plan.earlier)
        rows = [(r % plan.parts, 0, r, b) for r, b in covered_runs(plan, known)]
        part = (rolling.mix(rest["a"]) % np.uint64(plan.parts)).astype(np.int64)
        order = np.lexsort((rest["s"], rest["row"], part))
        rest, part = rest[order], part[order]
        cuts = np.searchsorted(part, np.arange(plan.parts + 1))
        rows += [(p, 1, None, pack(rest[i:j])) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return batch(SCAN, rows)

    for b in batches:
        rows, docs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        data, offsets = common.bytes_of(b.column(2))
        for i, j in common.chunks(offsets):
            at, text = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
            if j == i + 1 and len(text) > 2 * PIECE:  # windows that start in a piece lie in it and the next units
                x = word_values(text) if plan.unit == "words" else text
                for k in range(0, len(x), PIECE):
                    y = x[k : k + PIECE + plan.length - 1]
                    y = rolling.BYTE_VALUES[y] if plan.unit == "bytes" else y
                    held.append(runs_of(plan, y, np.array([0, len(y)]), rows[i:j], docs[i:j], k))
            else:
                held.append(runs_of(plan, *values(plan, text, at), rows[i:j], docs[i:j]))
            size += len(text)
            if size >= FLUSH_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, a list for each value of the first columns."""
    now, rows = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if r[:keys] != now and rows:
                yield rows
                rows = []
            now = r[:keys]
            rows.append(r)
    if rows:
        yield rows


def parted(plan: Plan, runs: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with units on a side, that meet runs of other classes with the same anchor and units there; their parts' keys
    and numbers of runs. Runs come in order of anchor and class."""
    gram, end = plan.gram + plan.half, runs["n"].astype(np.int64) + plan.length
    has = runs["at"] >= plan.half if side == "left" else runs["at"].astype(np.int64) + gram <= end
    at = np.flatnonzero(has)
    order = np.lexsort((runs["c"][at], runs[side][at], runs["a"][at]))
    at = at[order]
    r = runs[at]
    if not len(r):
        return at, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (r["a"][1:] != r["a"][:-1]) | (r[side][1:] != r[side][:-1]))
    other = new | np.append(True, r["c"][1:] != r["c"][:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(r)))
    if plan.earlier:  # someone must be later than another
        some = np.maximum.reduceat(r["doc"], first) > np.minimum.reduceat(r["doc"], first)
    else:  # someone must be alone in its class
        some = np.minimum.reduceat(r["w"], first) == 1
    some &= np.add.reduceat(other.astype(np.int64), first) > 1
    keep = np.repeat(some, size)
    key = rolling.mix(r["a"] * rolling.R + r[side].astype(np.uint64) * np.uint64(2) + np.uint64(side == "left"))
    return at[keep], key.view(np.int64)[keep], np.repeat(size, size)[keep]


def match(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's runs: kind 0 covered intervals, kind 1 candidates by row."""
    for rows in by_key(batches, 1):
        out = [(0, r[2], 0, r[3]) for r in rows if r[1] == 0]
        blobs = [unpack(r[3]) for r in rows if r[1] == 1]
        if blobs:
            rest, known, anchor, new = combined(np.concatenate(blobs), plan.earlier)
            out += [(0, r, 0, b) for r, b in covered_runs(plan, known)]
            kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(anchor)) if len(rest) else np.zeros(0, np.int64)
            rest = rest[np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(anchor), len(rest))))]
            sides = [parted(plan, rest, side) for side in ("left", "right")]
            at, key, size = (np.concatenate([s[k] for s in sides]) for k in range(3))
            order = np.argsort(rest["row"][at], kind="stable")
            left = rest[at[order]]
            c = np.zeros(len(left), CANDIDATE)
            c["key"], c["salts"] = key[order], -(-size[order] // SALT)
            for name in ("s", "n", "at", "w"):
                c[name] = left[name]
            cuts = np.flatnonzero(np.append(True, left["row"][1:] != left["row"][:-1])) if len(left) else []
            for i, j in zip(cuts, np.append(cuts[1:], len(left)), strict=True) if len(left) else []:
                out.append((1, int(left["row"][i]), int(c["salts"][i:j].max()), c[i:j].tobytes()))
        if out:
            yield batch(FOUND, out)


CONTEXT = pa.schema([(x, pa.int64()) for x in ("key", "salt", "row", "doc_id", "s")] + [(x, pa.int32()) for x in ("n", "at", "w", "salts")] + [("content", pa.binary())])
WINDOW = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("blob", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64()), ("w", pa.int32())])


def contents(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, doc_id, text and blobs of candidates: the candidates with what their runs cover (words as 32-bit hashes)."""
    for b in batches:
        data, offsets = common.bytes_of(b.column(2))
        rows, docs = b.column(0).to_pylist(), b.column(1).fill_null(0).to_pylist()
        for k, blobs in enumerate(b.column(3).to_pylist()):
            text = data[offsets[k] : offsets[k + 1]]
            if plan.unit == "words":
                text = (word_values(text) >> np.uint64(32)).astype("<u4")
            c = np.frombuffer(b"".join(blobs), CANDIDATE)
            salt = rolling.mix(np.array([rows[k]], np.int64).view(np.uint64))[0] % c["salts"].astype(np.uint64)
            for i in range(0, len(c), BLOCK):
                some = c[i : i + BLOCK]
                size = some["n"].astype(np.int64) + plan.length
                ends = np.cumsum(size)
                raw = text[np.repeat(some["s"].astype(np.int64) - (ends - size), size) + np.arange(ends[-1])]
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.append(0, ends) * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
                same = lambda x: pa.array(np.full(len(some), x, np.int64))  # noqa: B023, E731
                columns = [pa.array(some["key"]), pa.array(salt[i : i + BLOCK].astype(np.int64)), same(rows[k]), same(docs[k]), pa.array(some["s"].astype(np.int64))]
                columns += [pa.array(some[x].astype(np.int32)) for x in ("n", "at", "w", "salts")]
                yield pa.RecordBatch.from_arrays([*columns, raw], schema=CONTEXT)


@dataclass
class Block:
    """Candidates of whole parts: content in rows (padded), numbers of the parts, units of each, the anchor's place, doc_id and weight."""

    wide: np.ndarray
    group: np.ndarray
    sizes: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    weight: np.ndarray
    of: np.ndarray  # of each window, its candidate
    at: np.ndarray  # and its place there


#: From a plan and a block, a mask of the windows that are covered.
Kernel = Callable[[Plan, Block], np.ndarray]


def extend(plan: Plan, kernel: Kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole parts of candidates with one key and salt, in blocks; kind 0 covered intervals, kind 1 windows to meet
    those of the part's other salts."""
    kind = np.dtype(np.uint8 if plan.unit == "bytes" else "<u4")

    def block(rows: pa.Table) -> pa.RecordBatch:
        key, salt, row, doc, s, n, at, w, salts = (rows.column(i).to_numpy() for i in range(9))
        data, offsets = common.bytes_of(rows.column(9))
        data, offsets = np.frombuffer(data.tobytes(), kind), offsets // kind.itemsize
        size = np.diff(offsets)
        wide = np.zeros((len(key), int(size.max()) + plan.length), kind)
        wide[np.repeat(np.arange(len(key)), size), rolling.ranges(size)] = data
        group = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
        n = n.astype(np.int64)
        of, place = np.repeat(np.arange(len(key)), n + 1), rolling.ranges(n + 1)
        known = kernel(plan, Block(wide, group, size, at, doc, w, of, place))
        start = s[of] + place
        out = [(0, r, b, None, None, None, None, None) for r, b in intervals(row[of][known], start[known], start[known] + plan.length)]
        dealt = np.flatnonzero(salts[of] > 1)
        if len(dealt):
            ids = identities(wide[of[dealt][:, None], place[dealt][:, None] + np.arange(plan.length)], key[of[dealt]])
            weight = np.where(known[dealt] & (not plan.earlier), 2, w[of[dealt]])
            columns = row[of[dealt]], ids[:, 0], ids[:, 1], doc[of[dealt]], start[dealt], weight
            out += [(1, r, None, low, high, d, x, y) for r, low, high, d, x, y in zip(*[c.tolist() for c in columns], strict=True)]
        return batch(WINDOW, out)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= BLOCK:
            rows = pa.Table.from_batches(held).combine_chunks()
            key, salt = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            last = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))  # the last part may go on
            if len(last):
                yield block(rows.slice(0, int(last[-1]) + 1))
                rows = rows.slice(int(last[-1]) + 1)
            held, size = rows.to_batches(), rows.num_rows if len(last) else 0
    if held and sum(b.num_rows for b in held):
        yield block(pa.Table.from_batches(held).combine_chunks())


def identities(windows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row's content and part."""
    raw = windows.astype(np.uint64) + np.uint64(1)
    out = np.zeros((len(raw), 2), np.uint64)
    for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        up = np.cumprod(np.full(windows.shape[1], odd | 1, np.uint64), dtype=np.uint64)
        out[:, k] = rolling.mix((rolling.mix(raw + np.uint64(k)) * up).sum(1, dtype=np.uint64) ^ rolling.mix(key.view(np.uint64)))
    return out.view(np.int64)


def numbered(docs: DataFrame, parts: int) -> DataFrame:
    """row, doc_id and text: docs with a number a row, as a table in buckets of these numbers, so that joins by row don't
    shuffle texts again."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.bucketed(rows.repartition(parts, "row"), "row", parts, "rows")


def find(rows: DataFrame, plan: Plan, kernel: Kernel) -> DataFrame:
    """row and blobs, the covered intervals of units. rows: as `numbered` returns them."""
    ddl = "part int, kind int, row long, blob binary"
    seen = rows.filter("doc_id IS NOT NULL") if plan.earlier else rows
    runs = seen.select("row", "doc_id", "text").mapInArrow(lambda it: scan(plan, it), ddl)
    parts = runs.repartition(plan.parts, "part").sortWithinPartitions("part")
    found = common.cut(parts.mapInArrow(lambda it: match(plan, it), "kind int, row long, salts int, blob binary"))
    most = found.agg(F.max("salts")).first()[0] or 0
    known = found.filter("kind = 0").select("row", "blob")
    if not most:
        return known.groupBy("row").agg(F.collect_list("blob").alias("blobs"))
    wanted = found.filter("kind = 1").groupBy("row").agg(F.collect_list("blob").alias("blobs"))
    ddl = "key long, salt long, row long, doc_id long, s long, n int, at int, w int, salts int, content binary"
    around = seen.join(wanted, "row").select("row", "doc_id", "text", "blobs").mapInArrow(lambda it: contents(plan, it), ddl)
    groups = around.repartition(plan.parts, "key", "salt").sortWithinPartitions("key", "salt")
    ddl = "kind int, row long, blob binary, low long, high long, doc_id long, s long, w int"
    compared = common.cut(groups.mapInArrow(lambda it: extend(plan, kernel, it), ddl))
    if most > 1:
        windows = compared.filter("kind = 1")
        least = windows.groupBy("low", "high").agg(F.min("doc_id").alias("_least"), F.sum("w").alias("_n"))
        more = windows.join(least, ["low", "high"]).filter("doc_id > _least" if plan.earlier else "_n > 1")
        pair = more.groupBy("row").agg(F.collect_set("s").alias("starts"))
        known = known.unionByName(pair.mapInArrow(lambda it: starts_to_blobs(plan, it), "row long, blob binary"))
    known = known.unionByName(compared.filter("kind = 0").select("row", "blob"))
    return known.groupBy("row").agg(F.collect_list("blob").alias("blobs"))


def starts_to_blobs(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("blob", pa.binary())])
    for b in batches:
        rows = []
        for row, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.array(starts, np.int64)
            rows += list(intervals(np.full(len(x), row), x, x + plan.length))
        yield batch(schema, rows)


def spans_of(blobs: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint covered spans in order: starts and ends."""
    pairs = np.frombuffer(b"".join(blobs or []), "<u4").reshape(-1, 2).astype(np.int64)
    return rolling.merged(pairs[:, 0], pairs[:, 1])


def mask_of(blobs: list[bytes] | None, n: int) -> np.ndarray:
    start, end = spans_of(blobs)
    return rolling.covered(start, end, n)


def with_intervals(docs: DataFrame, plan: Plan, kernel: Kernel) -> DataFrame:
    """doc_id, text and blobs of covered intervals (null: none), a row for each of docs."""
    common.arrow_limits(docs.sparkSession)
    rows = numbered(docs, plan.parts)
    return rows.join(find(rows, plan, kernel), "row", "left").select("doc_id", "text", "blobs")


def span_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [[{"start": int(s), "end": int(e)} for s, e in zip(*spans_of(x), strict=True)] for x in b.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, kind)], ["doc_id", "repeats"])
