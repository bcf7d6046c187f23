"""The near-copy stage's third pass: families of texts that are similar, but mostly not similar enough."""

import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, near_copies


def texts(families=4, each=10):
    """Each text of a family with 2 to 6 scattered edits of its own: similarities of about 0.65 to 0.85."""
    r, out = random.Random(5), []
    for _ in range(families):
        base = [f"w{r.randrange(5000)}" for _ in range(300)]
        for k in range(each):
            w = list(base)
            for _ in range(2 + k % 5):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def test_each_text_of_a_family_gets_its_set_once(spark, monkeypatch, tmp_path):
    folder, real = str(tmp_path), near_copies.with_sets

    def noted(batches, shingle):
        for b in real(batches, shingle):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("".join(f"{k}\n" for k in b.column(b.schema.get_field_index("key")).to_pylist()))
            yield b

    monkeypatch.setattr(near_copies, "with_sets", noted)
    docs = spark.createDataFrame(list(enumerate(texts())), "key long, text string")
    near_copies.components(docs).collect()
    keys = [k for f in tmp_path.iterdir() for k in f.read_text().split()]
    assert len(keys) == len(set(keys)) > 20


@pytest.mark.parametrize(("parts", "few"), [(16, 100_000), (1, 0)])  # in pairs of parts and one task; block by block and in rounds
def test_families_over_a_group_lose_no_link(spark, monkeypatch, parts, few):
    monkeypatch.setattr(near_copies, "GROUP", 3)
    monkeypatch.setattr(near_copies, "FEW", 0)
    monkeypatch.setattr(near_copies, "PARTS", parts)
    monkeypatch.setattr(common, "FEW", few)
    rows = list(enumerate(texts()))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [[j for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)] for a in sets]
    least, before = list(range(len(rows))), None
    while before != least:
        before, least = least, [min(least[j] for j in x) for x in near]
    found = near_copies.components(spark.createDataFrame(rows, "key long, text string")).select("key", F.col("component")).collect()
    assert dict(map(tuple, found)) == {k: c for k, c in enumerate(least) if k != c} != {}


def test_a_dense_block_passes_on_a_spanning_forest():
    n = 30  # rows of one block, all of one fingerprint
    columns = [[7] * n, [100] * n, list(range(n)), [0] * n, [0] * n, [5] * n, list(range(n))]
    block = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], near_copies.ROW)
    out = [r for b in near_copies.still_open(iter([block])) for r in b.to_pylist()]
    edges = [(r["u"], r["v"]) for r in out if r["u"] is not None and r["token"] == 7]
    assert len(edges) == n - 1 and {k for e in edges for k in e} == set(range(n))
    assert sum(r["u"] is None for r in out) == n
