"""Near copies for the pipeline: links of a Jaccard similarity of 0.8 or more between sets of 5-word shingles.

Operator 4 comes first, all of it: fingerprints of 5-word shingles, their 32 segments' bit counts, grids, the range join and
the Manhattan distance in cells, then the exact comparison (simhash_dedup.fingerprinted, links). What it brings together is
checked by the sets and joined into components.

Fingerprints of 64 bits can't link all that is similar at 0.8 (see the README for their recall). The rest, the texts that are in
different components after that, is found in blocks that miss no link: a set's tokens are put in one order that holds for all
texts, and two sets of similarity 4/5 share a token among the first a - ceil(4a/5) + 1 of each. In a block, texts of
different components and fitting sizes and places are compared by marks, which are made of a set's tokens as a fingerprint is
of a text's shingles: the bit counts of 16 four-bit segments, whose Manhattan distance is a lower bound, then the differing
bits, at most BITS, then the sets themselves. Any order is right; tokens that are frequent in a sample come last, so that
boilerplate makes no large blocks. A pair that has also met on the token before is passed on there only.

A block passes on no more than two pairs a text: that with the smallest key and that with the nearest fingerprint, which
are verified and joined into components. A second pass over the rows that had any pair finds the pairs of different
components: those of blocks that have at most FEW a row are verified, too; other blocks, the dense ones, pass on spanning
forests of their pairs, whose components are families: texts that may be similar, directly or by others. Each text of a family
gets its set once, however many dense blocks it is in, and a third pass compares a family's texts by their sets and passes on
a spanning forest of the links. So no step has a row for each pair of a large block. Families of over GROUP texts are
dealt out in pairs of parts; those of over PARTS such parts are compared block by block. Words are runs of anything but space and 09 to 0D, A-Z lower-cased. Texts of fewer words than a shingle are one shingle;
texts without words (null, empty, white space) have the same one. Texts are known by a 64-bit hash, so equal ones are one; tokens by another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, rolling, simhash_dedup

SHINGLE = 5
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Texts of the sample, how many of them have a frequent token, and how many such tokens are known at most.
SAMPLE, FREQUENT, KNOWN = 8192, 4, 100_000
#: Differing bits of 64, for sets of at least STEADY tokens: similarity 0.8 gives 9.7 on average, and over 20 in 2 of 10,000 pairs.
BITS, STEADY = 20, 32
#: Rows of the join that are compared at once, but for a group of more; tokens of sets that are.
HELD, TOKENS = 1 << 18, 1 << 22
#: Pairs a row that a block passes on; a block with more is compared as a whole.
FEW = 2
#: Texts of a family (rows of a block) whose sets are compared in one task, and how many parts of so many a family has at most.
GROUP, PARTS = 4096, 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ROW = ["token", "size", "key", "at", "prev", "mark", "component"]
PAIR = ["u", "v"]
LOW48 = (1 << 48) - 1


def sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' distinct tokens in order of text and token, and the number of them before each text."""
    data, rows = LOWER[data], len(offsets) - 1
    starts, ends, before = rolling.words(data, offsets)
    p = rolling.sums(rolling.word_hashes(data, starts, ends))
    size = np.diff(before)
    n = np.maximum(size - shingle + 1, 0)
    few = np.flatnonzero(size < shingle)
    text = np.concatenate([np.repeat(np.arange(rows), n), few])
    long = rolling.grams(p, shingle)[np.repeat(before[:-1], n) + rolling.ranges(n)]
    tokens = np.concatenate([long, rolling.spans(p, before[few], before[few + 1])]).view(np.int64)
    order = np.lexsort((tokens, text))
    text, tokens = text[order], tokens[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (tokens[1:] != tokens[:-1])
    return tokens[new], np.append(0, np.cumsum(np.bincount(text[new], minlength=rows)))


def tokens_of(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """key and tokens of every row of key and text."""
    for b in batches:
        data, offsets = common.bytes_of(b.column(1))
        for i, j in common.chunks(offsets):
            tokens, before = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
            lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], ["key", "tokens"])


def marks(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A fingerprint of each set: a bit is 1 if it is set in over half of the tokens. No set is empty."""
    bits = np.unpackbits(np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, before[:-1], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.diff(before)[:, None], axis=1, bitorder="little").view("<i8").ravel()


def prefixes(batches: Iterator[pa.RecordBatch], shingle: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """token, size (tokens of the text), key, at (the token's place), prev (the token before it), mark and component of the first
    tokens of texts: key, text and component (null: the key)."""
    for b in batches:
        data, offsets = common.bytes_of(b.column(1))
        for i, j in common.chunks(offsets):
            keys = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
            own = pc.coalesce(b.column(2), b.column(0)).slice(i, j - i).to_numpy(zero_copy_only=False)
            tokens, before = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
            mark, size = marks(tokens, before), np.diff(before)
            text = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((tokens, simhash_dedup.among(frequent, tokens), text))
            tokens, at = tokens[order], rolling.ranges(size)
            prev = np.append(0, tokens[:-1])
            keep = at < (size + (-OVER * size // UNDER) + 1)[text]
            columns = tokens[keep] & LOW48, size[text][keep], keys[text][keep], at[keep], prev[keep] & LOW48, mark[text][keep], own[text][keep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ROW)


def counts(mark: np.ndarray) -> np.ndarray:
    """The bit counts of the 16 four-bit segments of each fingerprint, each in four bits."""
    x, two = mark.view(np.uint64), np.uint64(0x3333333333333333)
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (x & two) + ((x >> np.uint64(2)) & two)


def close(token, size, key, at, prev, mark, component) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (the first and the second, and their differing bits) that share a token, aren't of one component and may be
    similar, from rows in order of token and size; a row is first and second at most once each time."""
    segments = counts(mark).view(np.uint8).reshape(-1, 8)
    low, high = (segments & 15).astype(np.int8), (segments >> 4).astype(np.int8)
    i, d, rows = np.arange(len(token)), 0, len(token)
    while len(i):
        d += 1
        i = i[: np.searchsorted(i, rows - d)]
        i = i[token[i] == token[i + d]]
        i = i[UNDER * size[i] >= OVER * size[i + d]]  # the next ones are larger still
        k = i + d
        good = (key[i] != key[k]) & (component[i] != component[k])
        good &= (OVER + UNDER) * np.minimum(size[i] - at[i], size[k] - at[k]) >= OVER * (size[i] + size[k])
        good &= (at[i] == 0) | (at[k] == 0) | (prev[i] != prev[k])
        a, b = i[good], k[good]
        apart = np.abs(low[a] - low[b]).sum(1) + np.abs(high[a] - high[b]).sum(1)  # at most the differing bits
        near = (apart <= BITS) | (size[a] < STEADY)
        a, b = a[near], b[near]
        bits = np.bitwise_count((mark[a] ^ mark[b]).view(np.uint64)).astype(np.int64)
        near = (bits <= BITS) | (size[a] < STEADY)
        yield a[near], b[near], bits[near]


def met(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its pairs of keys, the smaller first, with the smallest key and with the nearest fingerprint; then a mask
    of the rows that have any pair."""
    key, none = rows[2], np.iinfo(np.int64).max
    least, nearest, near, some = np.full(len(key), none), np.full(len(key), none), np.full(len(key), BITS + 65), np.zeros(len(key), bool)
    for a, b, bits in close(*rows):
        some[a] = some[b] = True
        for small, large in ((a, b), (b, a)):
            own = key[small] < key[large]
            s, g, n = small[own], large[own], bits[own]
            least[g] = np.minimum(least[g], key[s])
            better = n < near[g]
            near[g[better]], nearest[g[better]] = n[better], key[s[better]]
    found = [np.stack([partner[partner < none], key[partner < none]], 1) for partner in (least, nearest)]
    return np.unique(np.concatenate(found), axis=0), some


def groups(batches: Iterator[pa.RecordBatch], keys: int, enough) -> Iterator[pa.Table]:
    """Whole groups of rows with equal first columns, from rows in order, as many as are enough (of a table)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if not enough(held):
            continue
        rows = pa.Table.from_batches(held)
        other = np.zeros(rows.num_rows, bool)
        for k in range(keys):
            x = rows.column(k).to_numpy()
            other[1:] |= x[1:] != x[:-1]
        last = np.flatnonzero(other)  # the last group may go on
        if len(last):
            yield rows.slice(0, int(last[-1]))
            rows = rows.slice(int(last[-1]))
        held = rows.to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def columns(rows: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [rows.column(x).to_numpy() for x in names]


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u and v of met texts, u < v, from rows of prefixes in order of token and size, then the rows that had any; a pair may
    come more than once."""
    for rows in groups(batches, 1, lambda held: sum(b.num_rows for b in held) >= HELD):
        rows = columns(rows, ROW)
        found, some = met(rows)
        for i in range(0, len(found), HELD):
            own = [pa.array(np.ascontiguousarray(found[i : i + HELD, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(own[0]), pa.int64())] * len(ROW)], PAIR + ROW)
        if some.any():
            own = [pa.array(x[some]) for x in rows]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(own[0]), pa.int64())] * 2, *own], PAIR + ROW)


def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks with at most FEW pairs a row, these as u and v, u < v; of the others the rows that have any, and the edges u
and v of a spanning forest of the pairs, with the block's token."""
    for rows in groups(batches, 1, lambda held: sum(b.num_rows for b in held) >= HELD):
        rows = columns(rows, ROW)
        key, block = rows[2], np.cumsum(np.append(False, rows[0][1:] != rows[0][:-1]))
        most = FEW * np.bincount(block)
        n, some, found = np.zeros(len(most), np.int64), np.zeros(len(key), bool), [np.zeros((0, 2), np.int64)]
        for a, b, _ in close(*rows):
            some[a] = some[b] = True
            n += np.bincount(block[a], minlength=len(n))
            few = n[block[a]] <= most[block[a]]
            found.append(np.stack([a[few], b[few]], 1))
        found = np.concatenate(found)
        found = found[n[block[found[:, 0]]] <= most[block[found[:, 0]]]]
        found = np.unique(np.sort(key[found], axis=1), axis=0)
        for i in range(0, len(found), HELD):
            own = [pa.array(np.ascontiguousarray(found[i : i + HELD, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(own[0]), pa.int64())] * len(ROW)], PAIR + ROW)
        some &= (n > most)[block]
        if some.any():
            dense = [x[some] for x in rows]
            own = [pa.array(x) for x in dense]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(own[0]), pa.int64())] * 2, *own], PAIR + ROW)
            label, key = np.arange(len(own[0])), dense[2]
            for a, b, _ in close(*dense):
                a, b = label[a], label[b]
                apart = a != b
                if apart.any():
                    label = simhash_dedup.joined(label, a[apart], b[apart])
            tied = np.flatnonzero(label != np.arange(len(label)))
            u, v = key[tied], key[label[tied]]
            edges = [pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(dense[0][tied])]
            yield pa.RecordBatch.from_arrays([*edges, *[pa.nulls(len(tied), pa.int64())] * (len(ROW) - 1)], PAIR + ROW)


def with_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """ROW and part of every row, with the tokens of its text."""
    for b in batches:
        data, offsets = common.bytes_of(b.column(len(ROW) + 1))
        for i, j in common.chunks(offsets):
            tokens, before = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
            lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[: len(ROW) + 1]], lists], [*ROW, "part", "tokens"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u and v, links whose components are those of all similar pairs of a family or block, from rows with sets in order of token,
part and size."""
    size_of = lambda held: sum(len(b.column(b.schema.get_field_index("tokens")).flatten()) for b in held)
    for rows in groups(batches, 2, lambda held: size_of(held) >= TOKENS):
        own = columns(rows, ROW)
        own[0] = own[0] ^ rolling.mix(rows.column("part").to_numpy().view(np.uint64)).view(np.int64)  # blocks of one token and part
        lists = rows.column("tokens").combine_chunks()
        flat, start = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        key, size = own[2], np.diff(start)
        label = np.arange(len(key))
        for a, b, _ in close(*own):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            for i in range(0, len(a), 1024):
                x, y = a[i : i + 1024], b[i : i + 1024]
                # the tokens of y's sets that x's have, too: both sorted, told apart by the pair
                left, right = np.repeat(np.arange(len(x)), size[x]), np.repeat(np.arange(len(y)), size[y])
                s, t = flat[np.repeat(start[x], size[x]) + rolling.ranges(size[x])], flat[np.repeat(start[y], size[y]) + rolling.ranges(size[y])]
                pair = np.concatenate([left, right])
                both = rolling.mix(np.concatenate([s, t]).view(np.uint64) ^ rolling.mix(pair.astype(np.uint64)))
                order = np.argsort(both, kind="stable")
                both, pair = both[order], pair[order]
                shared = np.bincount(pair[1:][both[1:] == both[:-1]], minlength=len(x))
                good = (OVER + UNDER) * shared >= OVER * (size[x] + size[y])
                u, v = label[x[good]], label[y[good]]
                u, v = u[u != v], v[u != v]
                if len(u):
                    label = simhash_dedup.joined(label, u, v)
        tied = np.flatnonzero(label != np.arange(len(label)))
        if len(tied):
            u, v = key[tied], key[label[tied]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], PAIR)


def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u and its component v (the smallest key) of every key of the links u and v that isn't its component."""
    held = [np.stack([b.column(k).to_numpy() for k in (0, 1)]) for b in batches]
    if not sum(x.shape[1] for x in held):
        return
    links = np.concatenate(held, axis=1)
    key, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(links.shape)
    apart = a != b
    label = simhash_dedup.joined(np.arange(len(key)), a[apart], b[apart])
    tied = np.flatnonzero(label != np.arange(len(key)))
    for i in range(0, len(tied), HELD):
        own = tied[i : i + HELD]
        yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(key[label[own]])], PAIR)


def together(links: DataFrame, *spent: DataFrame) -> DataFrame:
    """u and its component v (the smallest key) of the keys of links, which cut has returned, but for those that are their component. At
    most FEW links are joined in one task, which spares the driver the queries of operator 4's rounds; more go through these."""
    if links.count() <= common.FEW:
        found = links.coalesce(1).mapInArrow(ends, "u long, v long")
    else:
        found = simhash_dedup.components(links).select(F.col("doc_id").alias("u"), F.col("component").alias("v"))
    return common.cut(found, links, *spent)


def frequent_tokens(docs: DataFrame, shingle: int) -> np.ndarray:
    share = max(1, docs.count() // SAMPLE)
    some = docs.filter(F.pmod("key", F.lit(share)) == 0).mapInArrow(lambda it: tokens_of(it, shingle), "key long, tokens array<long>")
    some = some.select(F.explode("tokens").alias("token")).groupBy("token").count().filter(F.col("count") >= FREQUENT)
    return np.sort(np.array([r[0] for r in some.orderBy(F.desc("count"), "token").limit(KNOWN).select("token").collect()], np.int64))


def similar(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs u, v of found whose sets are similar. texts: key and tokens."""
    of = lambda x: texts.select(F.col("key").alias(x), F.col("tokens").alias(f"_{x}"))
    both = found.join(of("u"), "u").join(of("v"), "v")
    shared = F.size(F.array_intersect("_u", "_v")).cast("long")
    return both.filter((OVER + UNDER) * shared >= OVER * (F.size("_u") + F.size("_v"))).select("u", "v")


def by_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """u and v: keys that operator 4 brings together. Of texts with one fingerprint that of the smallest key stands for all."""
    prints = common.cut(docs.mapInArrow(lambda it: simhash_dedup.fingerprinted(it, shingle), "doc_id long, mark long"))
    marks = common.cut(prints.groupBy("mark").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "mark"))
    equal = prints.join(marks.select("mark", F.col("doc_id").alias("u")), "mark").filter("doc_id <> u").select("u", F.col("doc_id").alias("v"))
    found = simhash_dedup.links(marks).unionByName(equal)
    return common.cut(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), prints, marks)


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """key and component (a key) of the texts that have near copies, but for those whose key is the component. docs: key and
    text, no key twice."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    docs = docs.select("key", "text")
    ddl = ", ".join(f"{x} long" for x in ROW)

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(common.partitions(spark), *by).sortWithinPartitions(*by, "size", "key")

    def verified(found: DataFrame) -> DataFrame:
        keys = found.select(F.col("u").alias("key")).union(found.select("v")).distinct()
        texts = common.cut(docs.join(keys, "key", "left_semi").mapInArrow(lambda it: tokens_of(it, shingle), "key long, tokens array<long>"))
        return common.cut(similar(found, texts), texts, found)

    def few(df: DataFrame) -> DataFrame:
        df = common.cut(df)
        return F.broadcast(df) if df.count() <= common.FEW else df

    of = together(verified(by_fingerprint(docs, shingle)))
    common.tidy(spark)
    frequent = frequent_tokens(docs, shingle)
    known = docs.join(of.select(F.col("u").alias("key"), F.col("v").alias("component")), "key", "left")
    rows = known.select("key", "text", "component").mapInArrow(lambda it: prefixes(it, shingle, frequent), ddl)
    first = common.cut(dealt(rows, "token").mapInArrow(pairs, f"u long, v long, {ddl}"))
    common.tidy(spark)  # files of the shuffle, too
    stars = verified(common.cut(first.filter("u IS NOT NULL").select("u", "v").distinct()))
    of = together(common.cut(stars.unionByName(of), stars, of))
    common.tidy(spark)
    now = of.select(F.col("u").alias("key"), F.col("v").alias("_now"))
    rest = first.filter("u IS NULL").drop("u", "v").join(now, "key", "left").withColumn("component", F.coalesce("_now", "key"))
    rest = common.cut(dealt(rest.select(*ROW), "token").mapInArrow(still_open, f"u long, v long, {ddl}"), first)
    more = verified(common.cut(rest.filter("u IS NOT NULL AND token IS NULL").select("u", "v").distinct()))
    common.tidy(spark)
    family = together(common.cut(rest.filter("u IS NOT NULL AND token IS NOT NULL").select("u", "v").distinct()))
    dense = rest.filter("u IS NULL").drop("u", "v").join(family.select(F.col("u").alias("key"), F.col("v").alias("_f")), "key", "left")
    dense = dense.withColumn("_f", F.coalesce("_f", "key"))
    # a row for each text of a family, for each dense block of it where the family is too large
    texts = dense.groupBy("_f", "key").agg(*[F.first(x).alias(x) for x in ("size", "mark", "component")])
    wide = few(texts.groupBy("_f").count().filter(F.col("count") > GROUP * PARTS).select("_f"))
    zero = F.lit(0).cast("long")
    each = texts.join(wide, "_f", "left_anti").select(F.col("_f").alias("token"), "size", "key", zero.alias("at"), zero.alias("prev"), "mark", "component")
    each = common.cut(each.unionByName(dense.join(wide, "_f", "left_semi").select(*ROW)))
    large = few(each.groupBy("token").agg(F.ceil(F.count("*") / GROUP).alias("_k")).filter("_k > 1").select(F.col("token").alias("_t"), "_k"))
    # part b of k meets every part: a row for each pair of parts that has b
    k, b = F.coalesce("_k", F.lit(1)).cast("long"), F.pmod(F.xxhash64("key"), F.coalesce("_k", F.lit(1)))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.least(b, j) * k + F.greatest(b, j))
    parted = each.join(large, F.col("token") == F.col("_t"), "left").withColumn("part", F.explode(pair)).select(*ROW, "part")
    filled = parted.join(docs, "key").select(*ROW, "part", "text").mapInArrow(lambda it: with_sets(it, shingle), f"{ddl}, part long, tokens array<long>")
    filled = filled.select("token", "part", *ROW[1:], "tokens")
    whole = common.cut(dealt(filled, "token", "part").mapInArrow(linked, "u long, v long"), rest, family, each)
    common.tidy(spark)
    of = together(common.cut(of.unionByName(more).unionByName(whole)), of, more, whole)
    return of.select(F.col("u").alias("key"), F.col("v").alias("component"))


def chosen(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and key (xxhash64 of the text) of one row of each group of near copies, that of the smallest doc_id. docs: doc_id
    (not null) and text."""
    firsts = docs.groupBy(F.xxhash64("text").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    firsts = common.bucketed(firsts, "key", common.partitions(docs.sparkSession), "texts")
    of = components(firsts, shingle)
    least = F.min(F.struct("doc_id", "key")).alias("_least")
    each = firsts.select("key", "doc_id").join(of, "key", "left")
    return each.groupBy(F.coalesce("component", "key").alias("_c")).agg(least).select("_least.doc_id", "_least.key")
