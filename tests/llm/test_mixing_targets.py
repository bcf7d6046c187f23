"""The mix takes what its targets say, source by source, and its rates solve the entropy balance."""

import math
import random
from collections import Counter

import pytest

from tessera.llm import source_mixing

SCHEMA = "doc_id long, text string, source string, copies int, tier int, range int"


def test_taken_words_come_near_the_targets(spark):
    r = random.Random(7)
    rows = []
    for i in range(1200):
        size = r.choice([0, 1, 5, 20, 40, 41, 300, 300, 301]) if i % 97 else r.randrange(2000, 6000)
        rows.append((r.choice([i, i // 2, None]), " ".join(["w"] * size), r.choices(["a", "b", "c", None, "d"], [30, 4, 10, 3, 1])[0], 1, 2, 3))
    rows += [(7, "x y z", "a", 1, 2, 3)] * 300
    got = source_mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    taken, target, of = Counter(), {}, Counter()
    for x in got:
        taken[x.source] += x.taken
        of[x.source] += x.size
        target[x.source] = x.target
        assert 0 <= x.copies <= 2 and x.taken == x.copies * x.size
    for source, want in target.items():
        assert abs(taken[source] - want) <= max(40, 0.003 * want), (source, taken[source], want)
    assert sum(0.4 < target[s] / of[s] < 1.9 and abs(target[s] / of[s] - 1) > 0.02 for s in of) >= 1


def test_duals_solve_the_balance(spark):
    sizes = [("a", n, 3) for n in range(1, 60)] + [("b", n, 2) for n in (1, 10, 500)] + [(None, 4, 5)]
    total = Counter()
    for s, size, n in sizes:
        total[s] += size * n
    share = {"a": 0.3, "b": 1.4, None: 2.0}
    goals = spark.createDataFrame([(s, total[s], share[s] * total[s]) for s in total], "source string, source_size long, target double")
    found = source_mixing.solved(spark.createDataFrame(sizes, "source string, size long, n long"), goals, 2.0).collect()
    for x in found:
        tokens = sum(n * size * min(2.0, math.exp(min(50, x.dual * size / x.mean))) for s, size, n in sizes if s == x.source)
        assert tokens == pytest.approx(share[x.source] * total[x.source], rel=1e-5)
