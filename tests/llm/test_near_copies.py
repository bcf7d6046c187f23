"""The pipeline's near-duplicate stage against all pairs' exact Jaccard similarity."""

import random
import re

import pytest

import corpus_pipeline
from tessera.llm import near_copies, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def texts():
    r = random.Random(2)
    out = [None, "", " \n", "one", "One", "a b c d e", "a b c d f"]
    boiler = " ".join(f"licence{i}" for i in range(30))
    for _ in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 400))]
        out.append(" ".join(base))
        for _ in range(6):  # scattered edits: similarities from about 0.5 to 1
            w = list(base)
            for _ in range(r.randrange(1, max(2, len(w) // 30))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(w))
        out.append(" ".join(f"w{r.randrange(3000)}" for _ in range(60)) + " " + boiler)
    return out + [out[9], out[9].upper()]


@pytest.mark.parametrize(("group", "few"), [(4096, 2), (3, 0)])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, group, few):
    monkeypatch.setattr(near_copies, "GROUP", group)
    monkeypatch.setattr(near_copies, "FEW", few)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts())]
    sets = [shingles(t) for _, t, *_ in rows]
    least = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])] for a in sets]
    between = sum(0.8 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.9 for i in range(len(rows)) for j in near[i])
    assert between > 50
    before = None
    while before != least:
        before, least = least, [min(least[j] for j in x) for x in near]
    docs = spark.createDataFrame(rows + [(None, rows[8][1], "en", "s")] * 2, SCHEMA).repartition(3)
    got = [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert sorted(x for x in got if x is not None) == sorted(set(least)) and got.count(None) == 2


def test_operator_4_links_what_its_fingerprints_can(spark, monkeypatch):
    for step in ("pairs", "still_open", "linked"):  # the blocks find nothing
        monkeypatch.setattr(near_copies, step, lambda batches: (b for b in batches if b.num_rows < 0))
    r, rows = random.Random(3), []
    for _ in range(20):
        base = [f"w{r.randrange(3000)}" for _ in range(300)]
        for k in range(4):
            rows.append((len(rows), " ".join([*base[: 70 * k], *["edited"] * (k > 0), *base[70 * k + 1 :]]), "en", "s"))
    marks = [simhash_dedup.fingerprint(t.encode(), 5) for _, t, *_ in rows]
    near = [[j for j, m in enumerate(marks) if (m ^ n).bit_count() <= simhash_dedup.BITS] for n in marks]
    assert 80 < sum(map(len, near)) < 320 and all(i // 4 == j // 4 for i in range(80) for j in near[i])
    least, before = list(range(80)), None
    while before != least:
        before, least = least, [min(least[j] for j in x) for x in near]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted(x.doc_id for x in got) == sorted(set(least))
