"""Operator 4, SimHash near-dedup by segment-popcount embedding.

A text's fingerprint: words (runs of anything but space and 09 to 0D, A-Z lower-cased), shingles of 4 words, repeats
included, joined by spaces (fewer words: all of them; none: fingerprint zero); a bit is 1 if it is set in over half of
the shingles' XXH64 hashes (seed 42).

Fingerprints link at `bits` or fewer differing bits. Each is mapped to the bit counts of its 32 two-bit segments; the
Manhattan distance of two such vectors is at most the number of differing bits. The segments are dealt into m + bits
groups; a pair within the distance agrees in the counts of at least m groups, so each choice of m groups makes a grid in
whose cells all links are found. m grows with the number of distinct fingerprints (`agreeing`), so that cells stay small. In a
cell fingerprints are put in order of their total bit count and joined by range: those within `bits` of each other by this
count, then by the Manhattan distance, which is one XOR of counts in unary, are compared exactly. A cell passes on a spanning
forest of its links, not the links: the components are the same. A cell of over CELL fingerprints is dealt into blocks,
and pairs of blocks are compared in tasks of their own.

Only distinct fingerprints are compared, each named by its smallest doc_id. Components come from large-star/small-star
rounds over the forests, each round a written table. A doc_id is one node, so rows of one doc_id have one component, even
where their texts, and so fingerprints, differ. Rows without a doc_id link nothing and have no component. Null and empty
texts link like any other. A table without rows gives none. A long text's shingles are hashed BLOCK at a time. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SHINGLE, SEED, BITS = 4, 42, 4
#: Fingerprints of a cell that are compared as one block.
CELL = 8192
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.append(0, ends[: n - 1] + 1).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def among(some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is in some, which is in order."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def fingerprinted(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = common.bytes_of(b.column(1))
        marks = [fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), shingle) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], ["doc_id", "mark"])


def agreeing(n: int, bits: int) -> int:
    """How many groups to agree in: the least work for n fingerprints, were their bits random. A segment's count has
    1.5 bits of information; a row of a grid is worth about 200 comparisons."""
    cost = lambda m: comb(m + bits, m) * (200 + n / 2 ** (48 * m / (m + bits)) / 2)
    return min(range(2, 7), key=cost)


def grids(bits: int, m: int = 2) -> list[int]:
    """A mask of 64 bits for each choice of m groups of segments."""
    groups = [sum(3 << (2 * s) for s in part.tolist()) for part in np.array_split(np.arange(32), m + bits)]
    return [sum(some) for some in combinations(groups, m)]


def unary(marks: np.ndarray) -> np.ndarray:
    """The bit counts of the segments as 00, 01 and 11, so that the Manhattan distance is the number of differing bits."""
    odd = np.uint64(0x5555555555555555)
    high, low = (marks >> np.uint64(1)) & odd, marks & odd
    return ((high & low) << np.uint64(1)) | high | low


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(marks: DataFrame, bits: int, m: int) -> DataFrame:
    """doc_id, mark, and a row for each grid: its number and the counts of its segments, two bits each."""
    odd = signed(0x5555555555555555)
    x = F.col("mark")
    counts = F.shiftrightunsigned(x, 1).bitwiseAND(odd).bitwiseXOR(x.bitwiseAND(odd))  # low bit of each count
    both = F.shiftrightunsigned(x, 1).bitwiseAND(x).bitwiseAND(odd)  # segments with two ones
    counts = counts.bitwiseOR(F.shiftleft(both, 1))
    each = F.array(*[F.struct(F.lit(i).alias("grid"), counts.bitwiseAND(signed(mask)).alias("cell")) for i, mask in enumerate(grids(bits, m))])
    return marks.select("doc_id", "mark", F.explode(each).alias("_g")).select("doc_id", "mark", "_g.grid", "_g.cell")


def forest(ids: np.ndarray, marks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, smallest doc_id of its component) of those that have links, all pairs looked at in blocks."""
    ones = np.bitwise_count(marks)
    order = np.argsort(ones, kind="stable")
    ids, marks, ones = ids[order], marks[order], ones[order].astype(np.int64)
    to = np.searchsorted(ones, ones + bits, "right")
    n, label, counts = len(ids), np.arange(len(ids)), unary(marks)
    width = max(1, (1 << 22) // max(1, n))
    for i in range(0, n, width):
        j = min(n, i + width)
        a, b = np.nonzero(np.bitwise_count(counts[i:j, None] ^ counts[None, i : to[j - 1]]) <= bits)
        a, b = a + i, b + i
        near = (b > a) & (np.bitwise_count(marks[a] ^ marks[b]) <= bits)
        a, b = label[a[near]], label[b[near]]
        a, b = a[a != b], b[a != b]
        if len(a):
            label = joined(label, a, b)
    root = label
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    out = least[root]
    keep = out != ids
    return ids[keep], out[keep]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the place of its tree's root) after the trees of a and b, roots both, are one."""
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
        a, b = label[low], label[high]
        # an edge that lost to a smaller one stays until both ends have one root
        a, b = a[a != b], b[a != b]
    return label


LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def linked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of whole cells from rows in order of (grid, cell, part): doc_id, mark and those three columns."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush(rows) -> Iterator[pa.RecordBatch]:
        ids, marks = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        if len(ids) > 1:
            u, v = forest(ids, marks.view(np.uint64), bits)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=LINK)

    last = None
    for b in batches:
        ids, marks, grid, cell, part = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.flatnonzero((grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        for i, j in zip(np.append(0, new).tolist(), np.append(new, len(ids)).tolist(), strict=True):
            key = (grid[i], cell[i], part[i]) if j > i else last
            if key != last and held:
                yield from flush(held)
                held = []
            held.append((ids[i:j], marks[i:j]))
            last = key
    if held:
        yield from flush(held)


def links(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """u, v: edges whose components are those of all links. marks: doc_id and mark, no mark twice."""
    spark = marks.sparkSession
    placed = cells(marks, bits, agreeing(marks.count(), bits))
    sizes = placed.groupBy("grid", "cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > CELL)
    large = common.cut(sizes)
    if large.isEmpty():
        dealt = placed.withColumn("part", F.lit(0).cast("long"))
    else:
        # block b of k meets every block: a row for each pair of blocks that has b
        blocks = F.coalesce(F.ceil(F.col("_n") / CELL), F.lit(1)).cast("long")
        b, k = F.pmod(F.xxhash64("mark"), F.col("_k")), F.col("_k")
        pair = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.least(F.col("_b"), j) * k + F.greatest(F.col("_b"), j))
        dealt = placed.join(large, ["grid", "cell"], "left").withColumn("_k", blocks).withColumn("_b", b)
        dealt = dealt.withColumn("part", F.explode(pair)).select("doc_id", "mark", "grid", "cell", "part")
    dealt = dealt.repartition(common.partitions(spark), "grid", "cell", "part").sortWithinPartitions("grid", "cell", "part")
    return dealt.mapInArrow(lambda it: linked(it, bits), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """doc_id and component (smallest id) of every id in an edge, by large-star and small-star rounds."""
    now, before = common.cut(edges.distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = common.cut(small, now)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        before = state


def cluster(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row for each of docs (doc_id, text)."""
    common.arrow_limits(docs.sparkSession)
    rows = common.cut(docs.select("doc_id", "text").mapInArrow(lambda it: fingerprinted(it, shingle), "doc_id long, mark long"))
    marks = common.cut(rows.filter("doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "mark"))
    found = components(links(marks, bits))
    of = marks.join(found, "doc_id", "left").select("mark", F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.join(of, "mark", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op4_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return cluster(common.documents(spark, sf_dir))
