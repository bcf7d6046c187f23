"""Operator 7, token ids in a Huffman-coded file.

Texts are encoded with a public tokenizer, each document ends with id 0, and the ids are written in ascending order of
doc_id with a canonical, length-limited Huffman code made from the counts of all ids. A shard holds about SHARD bytes of
ids: its documents' ids and lengths, a bit string, and the bit offset of every BLOCK-th id. Blocks can be decoded alone;
a reader decodes all of a shard's blocks side by side with one table.

The format (a Parquet table, as executors write only through Spark): `code` has one row, the code length of every id;
`shards` has part, shard, n_docs, n_tokens, doc_ids (64-bit; the first null_ids of them are null), doc_tokens, checkpoints (64-bit bit offsets) and
bits (most significant bit first, padded). Shards in order of (part, shard) have the documents in order.

A task encodes each distinct unit (a space and what follows it up to the next one) once. Ids are two bytes each until they are
written, if the vocabulary allows. Null and empty texts are id 0 alone; a long text is encoded in pieces that part at units. Rows without a doc_id come first; rows of one doc_id follow each other in order of
a hash of their ids. Extra columns are ignored. A table without rows has no shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Longest code in bits; a table of 2^LONGEST entries decodes.
LONGEST = 18
BLOCK = 256
SHARD = 4 << 20
#: Bytes of text whose ids are looked up at once; a longer text goes in pieces.
PIECE = 1 << 20
#: Units whose ids a task remembers, and the longest of them in bytes.
KNOWN, LONG = 1 << 20, 64


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def width(path: str) -> int:
    """Bytes of an id."""
    return 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4


# second bytes of white space in UTF-8, after C2, E1, E2 or E3
WHITE_LEAD, WHITE_NEXT = np.zeros(256, bool), np.zeros(256, bool)
WHITE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
WHITE_NEXT[[0x80, 0x81, 0x85, 0x9A, 0xA0]] = True
# bit 1: ASCII letters and digits, bit 0: other printing ASCII, bit 2: second bytes of the letters whose first byte is C3
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = 1
KINDS[0x30:0x3A] = KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = 2
KINDS[0x80:0xC0] = 4
KINDS[[0x97, 0xB7]] = 0
KINDS = KINDS.tobytes()
LINE_END = 0x0A


def cuts(data: np.ndarray) -> np.ndarray:
    """A mask of places where a byte-level tokenizer's words begin, whatever else is in the text: at a space before
    something else than white space (it goes with the word after it, and of a run of white space all but the last goes on its
    own), at a mark after a letter or digit, and on both sides of a line end that stands alone between ASCII characters."""
    out = np.zeros(len(data), bool)
    if len(data) < 3:
        return out
    at = np.flatnonzero(data[:-1] == 0x20)
    after = data[at + 1]
    white = WHITE_LEAD[after] & WHITE_NEXT[data[np.minimum(at + 2, len(data) - 1)]]
    out[at[(after > 0x20) & ~white]] = True
    kind, bits = np.frombuffer(data.tobytes().translate(KINDS), np.uint8), out.view(np.uint8)
    mark = kind & 1
    bits[1:] |= mark[1:] & (kind[:-1] >> 1)
    bits[2:] |= mark[2:] & (kind[1:-1] >> 2) & (data[:-2] == 0xC3)
    seen = lambda x: (x > 0x20) & (x < 0x7F)
    at = 1 + np.flatnonzero(data[1:-1] == LINE_END)
    at = at[seen(data[at - 1]) & seen(data[at + 1])]
    out[at] = out[at + 1] = True
    return out


def extended(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """array with more after its first `used` values, copied only if there is no room behind these."""
    end = used + len(more)
    if end > len(array):
        array, old = np.empty(max(end, 2 * len(array)), array.dtype), array
        array[:used] = old[:used]
    array[used:end] = more
    return array


class Encoder:
    """Ids of texts by their units, the stretches between cuts: the library encodes each distinct unit once, and numpy
    puts their ids together. The ids are those of the whole text, as the library parts texts at the cuts too. Texts are
    units themselves if the tokenizer isn't a plain byte-level one."""

    def __init__(self, path: str) -> None:
        self.coder, self.kind = tokenizer(path), np.dtype(f"<u{width(path)}")
        how = json.loads(self.coder.to_str())
        words = how.get("pre_tokenizer") or {}
        self.parted = how.get("normalizer") is None and words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space")
        self.parted = bool(self.parted) and all(x["special"] for x in how.get("added_tokens", []))
        between = self.coder.encode("\n", add_special_tokens=False).ids
        self.between = between[0] if self.parted and len(between) == 1 else None
        self.known: dict[bytes, int] = {}
        # the ids of slot k are flat[first[k] : first[k + 1]], slot 0 is the end; of both arrays only the beginnings are in use
        self.flat, self.first, self.used = np.array([END], self.kind), np.array([0, 1], np.int64), 1

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and each one's number of ids."""
        lists = [x.ids for x in self.coder.encode_batch_fast(units, add_special_tokens=False)]
        size = np.array([len(x) for x in lists], np.int64)
        return np.fromiter((i for x in lists for i in x), self.kind, int(size.sum())), size

    def encode_joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for units without white space but a space before them: as one text with line ends between, which are
        tokens of their own there."""
        ids = np.array(self.coder.encode_batch_fast(["\n".join(units)], add_special_tokens=False)[0].ids, self.kind)
        between = ids == self.between
        parts = np.concatenate([[-1], np.flatnonzero(between), [len(ids)]])
        return ids[~between], np.diff(parts) - 1

    def slots(self, units: np.ndarray) -> np.ndarray:
        """Where the ids of distinct units (bytes) are."""
        found = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(found < 0)
        room = len(self.known) + len(new) <= KNOWN
        groups: dict[tuple[bool, bool], list[tuple[int, str]]] = {(kept, plain): [] for kept in (True, False) for plain in (True, False)}
        for k, raw in zip(new.tolist(), units[new], strict=True):
            unit = raw.decode()
            word = unit[1:] if unit[:1] == " " else unit
            groups[room and len(unit) <= LONG, self.between is not None and word.split() == [word]].append((k, unit))
        for (kept, plain), some in groups.items():
            if some:
                ids, size = (self.encode_joined if plain else self.encode)([unit for _, unit in some])
                at, end = [k for k, _ in some], int(self.first[self.used])
                found[at] = np.arange(self.used, self.used + len(some))
                self.flat = extended(self.flat, end, ids)
                self.first = extended(self.first, self.used + 1, end + np.cumsum(size))
                if kept:
                    self.known.update(zip(units[at], range(self.used, self.used + len(some)), strict=True))
                self.used += len(some)
        return found

    def forget(self) -> None:
        """Drops the ids of units that aren't known, which come last, and the room that a call with many of them has taken."""
        self.used = len(self.known) + 1
        end = int(self.first[self.used])
        if len(self.flat) > 4 * max(end, PIECE):
            self.flat = self.flat[: 2 * end].copy()
        if len(self.first) > 4 * max(self.used, PIECE):
            self.first = self.first[: 2 * self.used].copy()

    def ids(self, data: np.ndarray, offsets: np.ndarray, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids before each text."""
        edge = np.append(cuts(data), False) if self.parted else np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edges = np.flatnonzero(edge)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        units = units.dictionary_encode()
        slots = self.slots(units.dictionary.to_numpy(zero_copy_only=False))
        slots = slots[units.indices.to_numpy()] if len(edges) > 1 else np.zeros(0, np.int64)
        before = np.searchsorted(edges, offsets)
        if end:
            slots = np.insert(slots, before[1:], 0)
            before = before + np.arange(len(before))
        start = self.first[slots]
        size = self.first[slots + 1] - start
        done = np.append(0, np.cumsum(size))
        out = self.flat[np.arange(done[-1]) + np.repeat(start - done[:-1], size)]
        self.forget()
        return out, done[before]

    def long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text, in pieces of about PIECE bytes that end at cuts."""
        parts, at = [], 0
        while at < len(data):
            stop, reach = len(data), PIECE
            while self.parted and at + reach < len(data):
                found = np.flatnonzero(cuts(data[at : at + reach]))
                if len(found) and found[-1] > 0:
                    stop = at + int(found[-1])
                    break
                reach *= 2
            parts.append(self.ids(data[at:stop], np.array([0, stop - at]), False)[0])
            at = stop
        return np.concatenate([*parts, np.array([END], self.kind)])


@cache
def kept_encoder(path: str) -> Encoder:
    """One a worker process, which remembers units from task to task."""
    return Encoder(path)


def encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, ids (two bytes each, four for a larger vocabulary, with the end) from doc_id and text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = kept_encoder(path)
    for b in batches:
        data, offsets = common.bytes_of(b.column(1))
        for i, j in common.chunks(offsets, PIECE):
            text, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if j == i + 1 and len(text) > PIECE:
                ids = encoder.long(text)
                at = np.array([0, len(ids)])
            else:
                ids, at = encoder.ids(text, at)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * ids.itemsize).astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), raw.cast(pa.binary())], ["doc_id", "ids"])


def counted(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        ids, _ = common.bytes_of(b.column(1))
        n = np.bincount(np.frombuffer(ids.tobytes(), kind))
        total = np.pad(total, (0, max(0, len(n) - len(total))))
        total[: len(n)] += n
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["id", "n"])


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code with none over `longest`, by package-merge; 0 for ids that never occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        out[ids] = 1
        return out
    if len(ids) > 1 << longest:
        raise ValueError(f"{len(ids)} ids need codes of over {longest} bits")
    order = np.argsort(counts[ids], kind="stable")
    leaves = counts[ids][order].astype(np.int64)
    levels, row = [], leaves
    for _ in range(longest - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        row = both[by]
    lengths, take = np.zeros(len(ids), np.int64), 2 * len(ids) - 2
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out[ids[order]] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    longest = int(size.max()) if len(size) else 0
    step = np.int64(1) << (longest - size)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = (np.cumsum(step) - step) >> (longest - size)
    return codes


def packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of ids and the bit offset of every block's first id."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    end = int(size.sum())
    word = at >> 5
    value = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)  # from the word of 32 bits that a code begins in, into the next
    first = np.flatnonzero(np.diff(word, prepend=-1))
    value, word = np.add.reduceat(value, first), word[first]  # codes share words but no bits
    wide = np.zeros(end // 32 + 4, np.uint64)
    wide[word] += value >> np.uint64(32)
    wide[word + 1] += value & np.uint64(0xFFFFFFFF)
    return wide.astype(">u4").tobytes()[: end // 8 + 9], at[::BLOCK]


def table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for every string of as many bits as the longest code has."""
    longest = int(lengths.max())
    order = np.flatnonzero(lengths)
    order = order[np.argsort(codes[order] << (longest - lengths[order].astype(np.int64)), kind="stable")]
    repeat = 1 << (longest - lengths[order].astype(np.int64))
    ids, size = np.repeat(order, repeat), np.repeat(lengths[order], repeat)
    rest = (1 << longest) - len(ids)
    return np.pad(ids, (0, rest)), np.pad(size, (0, rest)), longest


def unpacked(bits: bytes, checkpoints: np.ndarray, n: int, decoder, block: int = BLOCK) -> np.ndarray:
    """Ids of a shard: one step for each place in a block, all blocks at once."""
    ids, size, longest = decoder
    data = np.frombuffer(bits, np.uint8).astype(np.int64)
    out = np.zeros((len(checkpoints), block), np.uint32)
    at = checkpoints.astype(np.int64).copy()
    for k in range(block):
        live = len(at) if k < (n - 1) % block + 1 else len(at) - 1
        if live <= 0:
            break
        byte = at[:live] >> 3
        window = (data[byte] << 24) | (data[byte + 1] << 16) | (data[byte + 2] << 8) | data[byte + 3]
        key = (window >> (32 - longest - (at[:live] & 7))) & ((1 << longest) - 1)
        out[:live, k] = ids[key]
        at[:live] += size[key]
    return out.ravel()[:n]


SHARDS = (
    "part long, shard long, n_docs long, n_tokens long, doc_ids binary, null_ids long, doc_tokens binary, checkpoints binary, bits binary"
)


def sharded(lengths: np.ndarray, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, part, shard = canonical(lengths), TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(x for _, x in held), kind)
        bits, checkpoints = packed(ids, lengths, codes)
        doc_ids = np.array([d or 0 for d, _ in held], "<i8").tobytes()
        doc_tokens = np.array([len(x) // ids.itemsize for _, x in held], "<i8").tobytes()
        nulls = sum(d is None for d, _ in held)  # these come first
        row = [part, shard, len(held), len(ids), doc_ids, nulls, doc_tokens, checkpoints.astype("<i8").tobytes(), bits]
        names = [x.split()[0] for x in SHARDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    for b in batches:
        for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and size + len(ids) > SHARD:
                yield flush()
                held, size, shard = [], 0, shard + 1
            held.append((doc, ids))
            size += len(ids)
    if held:
        yield flush()


def write(docs: DataFrame, path: str, vocabulary: str | None = None, longest: int = LONGEST) -> None:
    """Encodes docs (doc_id, text) into the format at path."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    file = vocabulary or public_tokenizers.path(TOKENIZER)
    kind = f"<u{width(file)}"
    table = common.cut(docs.select("doc_id", "text").mapInArrow(lambda it: encoded(file, it), "doc_id long, ids binary"))
    counts = table.mapInArrow(lambda it: counted(kind, it), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row an id of the vocabulary
    ids, n = counts.column("id").to_numpy(), counts.column("n").to_numpy()
    total = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    total[ids] = n
    lengths = code_lengths(total, longest)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code")
    # equal rows part by their place in the table, so that many of them don't meet in one task
    rows = table.withColumn("_hash", F.xxhash64("ids")).withColumn("_place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_place").asc()]
    rows = rows.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    rows.mapInArrow(lambda it: sharded(lengths, kind, it), SHARDS).write.option("compression", "none").parquet(f"{path}/shards")
    common.drop(table)


def pieces(lengths: np.ndarray, batches: Iterator[pa.RecordBatch]):
    """doc_ids (null ones first), starts, numbers of ids and ids of each shard, and how many of the first have no doc_id."""
    decoder = table(lengths, canonical(lengths)) if lengths.any() else None
    for b in batches:
        for r in b.to_pylist():
            ids = unpacked(r["bits"], np.frombuffer(r["checkpoints"], "<i8"), r["n_tokens"], decoder).astype("<u4")
            sizes, docs = np.frombuffer(r["doc_tokens"], "<i8"), np.frombuffer(r["doc_ids"], "<i8")
            ends = np.cumsum(sizes)
            doc = pa.array(docs, mask=np.arange(len(docs)) < r["null_ids"])
            raw = ids.tobytes()
            each = (raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True))
            yield [doc, pa.array(r["base"] + ends - sizes), pa.array(sizes)], each


def decoded(lengths: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns, each in pieces(lengths, batches):
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(each), pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def digested(lengths: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns, each in pieces(lengths, batches):
        yield pa.RecordBatch.from_arrays([*columns, pa.array([zlib.crc32(x) for x in each], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def shards(spark: SparkSession, path: str) -> tuple[np.ndarray, DataFrame]:
    """The code lengths at path, and its shards with `base`, the ids of all documents before each."""
    common.arrow_limits(spark)
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()[0], np.uint8)
    found = spark.read.parquet(f"{path}/shards")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = lambda w: F.coalesce(F.sum(w).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("_n").alias("_before"))  # a row for each of the partitions that wrote
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = found.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("_within")).join(parts, "part")
    base = base.select("part", "shard", (F.col("_within") + F.col("_before")).alias("base"))
    return lengths, found.join(base, ["part", "shard"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (four bytes each) from the format at path."""
    lengths, rows = shards(spark, path)
    return rows.mapInArrow(lambda it: decoded(lengths, it), "doc_id long, start long, n_tokens long, ids binary")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as four bytes each) from the format at path."""
    lengths, rows = shards(spark, path)
    return rows.mapInArrow(lambda it: digested(lengths, it), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs to a new path in the shared folder and returns doc_id, start, n_tokens and ids_crc32 from there."""
    path = common.new_path(docs.sparkSession, "token_ids")
    write(docs, path)
    return digest(docs.sparkSession, path)


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir))
