"""Substring and suffix-array dedup against brute force: repeated and missing ids, long texts in pieces, dealt-out parts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import repeats, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, blobs string, row int"  # names that the operators use themselves


def batch(names, kinds, rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def covered(docs, plan, kernel):
    """Covered units by row, by the steps that Spark runs."""
    rows = [(k, d, t) for k, (d, t) in enumerate(docs) if not (plan.earlier and d is None)]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    halves = [batch(["row", "doc_id", "text"], kinds, x) for x in (rows[: len(rows) // 2], rows[len(rows) // 2 :]) if x]
    lines = lambda batches: [r for o in batches for r in zip(*[c.to_pylist() for c in o.columns], strict=True)]
    runs = [r for b in halves for r in lines(repeats.scan(plan, iter([b])))]
    blobs, wanted = defaultdict(list), defaultdict(list)
    for p in range(plan.parts):
        some = [r for r in runs if r[0] == p]
        for kind, row, _, blob in lines(repeats.match(plan, iter([repeats.batch(repeats.SCAN, some)]))) if some else []:
            (wanted if kind else blobs)[row].append(blob)
    some = [(*r, wanted[r[0]]) for r in rows if r[0] in wanted]
    if some:
        found = list(repeats.contents(plan, iter([batch(["row", "doc_id", "text", "blobs"], [*kinds, pa.list_(pa.binary())], some)])))
        table = pa.Table.from_batches(found).sort_by([("key", "ascending"), ("salt", "ascending")])
        least, n, windows = {}, Counter(), []
        for kind, row, blob, low, high, doc, s, w in lines(repeats.extend(plan, kernel, iter(table.to_batches(max_chunksize=7)))):
            if kind == 0:
                blobs[row].append(blob)
                continue
            least[low, high] = min(least.get((low, high), doc), doc)
            n[low, high] += w
            windows.append((row, (low, high), doc, s))
        for row, key, doc, s in windows:
            if doc > least[key] if plan.earlier else n[key] > 1:
                blobs[row].append(np.array([[s, s + plan.length]], "<u4").tobytes())
    return blobs


def brute(docs, plan):
    places, units = defaultdict(list), []
    for k, (d, t) in enumerate(docs):
        u = (t or "").encode() if plan.unit == "bytes" else tuple(WORD.findall(t or ""))
        units.append(u)
        for i in range(len(u) - plan.length + 1):
            places[u[i : i + plan.length]].append((d, k, i))
    gone = [set() for _ in docs]
    for found in places.values():
        ids = [d for d, _, _ in found if d is not None]
        for d, k, i in found:
            if d is not None and min(ids) < d if plan.earlier else len(found) > 1:
                gone[k] |= set(range(i, i + plan.length))
    return units, gone


def some_docs(r):
    words = [f"w{i}" for i in range(r.choice([2, 30, 300]))]
    bases = [[r.choice(words) for _ in range(r.randrange(5, 200))] for _ in range(5)]
    docs = []
    for k in range(25):
        text = []
        for _ in range(r.randrange(0, 4)):
            base = r.choice(bases)
            i = r.randrange(len(base))
            part = base[i : i + r.randrange(1, 150)]
            if part and r.random() < 0.6:
                part[r.randrange(len(part))] = r.choice(words)
            text += part
        docs.append((r.choice([None, k, k // 3, 1]), " ".join(text) if r.random() < 0.95 else None))
    return docs + docs[:2]


PLANS = {
    "words": (repeats.Plan("words", 35, 12, False, 3), substring_dedup.extended),
    "bytes": (repeats.Plan("bytes", 50, 16, True, 3), suffix_dedup.shared),
}


@pytest.mark.parametrize("unit", PLANS)
def test_steps_cover_what_brute_force_does(unit, monkeypatch):
    plan, kernel = PLANS[unit]
    for seed in range(25):
        r = random.Random(seed)
        for name, values in (("SALT", [2, 5, 1 << 15]), ("BLOCK", [1, 8, 4096]), ("PIECE", [64, 200, 1 << 20]), ("FLUSH_BYTES", [300, 16 << 20])):
            monkeypatch.setattr(repeats, name, r.choice(values))
        docs = some_docs(r)
        blobs, (units, gone) = covered(docs, plan, kernel), brute(docs, plan)
        for k, u in enumerate(units):
            assert set(np.flatnonzero(repeats.mask_of(blobs.get(k), len(u))).tolist()) == gone[k], (seed, k)


def table(spark):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    a, b, c = text(60), text(60), text(200)
    rows = [(1, a), (1, b), (2, a), (None, c), (5, c), (6, f"{text(20)} {c[:700]}\n{text(30)}"), (7, None), (8, ""), (9, b[:100]), (9, b[:100]), (None, None)]
    return rows, spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA).repartition(3)


def test_substring_rows_are_texts_of_their_own(spark):
    rows, docs = table(spark)
    units, gone = brute(rows, PLANS["words"][0])
    kept = [" ".join(w for k, w in enumerate(u) if k not in g) for u, g in zip(units, gone, strict=True)]
    want = Counter((d, len(u), len(g), hashlib.sha256(x.encode()).hexdigest(), x) for (d, _), u, g, x in zip(rows, units, gone, kept, strict=True))
    assert Counter(tuple(r) for r in substring_dedup.dedup(docs).collect()) == want
    spans = Counter((r.doc_id, tuple((x.start, x.end) for x in r.repeats)) for r in substring_dedup.maximal_repeats(docs).collect())
    ends = lambda g: tuple((i, next(j for j in range(i, 10**6) if j not in g)) for i in sorted(g) if i - 1 not in g)
    assert spans == Counter((d, ends(g)) for (d, _), g in zip(rows, gone, strict=True))


def test_suffix_rows_are_texts_of_their_own(spark):
    rows, docs = table(spark)
    units, gone = brute(rows, PLANS["bytes"][0])
    want = Counter()
    for (d, _), u, g in zip(rows, units, gone, strict=True):
        kept = bytes(x for k, x in enumerate(u) if k not in g)
        want[d, len(u), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(kept).hexdigest(), kept] += 1
    assert Counter((*r[:5], bytes(r[5])) for r in suffix_dedup.dedup(docs).collect()) == want
