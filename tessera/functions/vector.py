"""Vector distances as native expressions over array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _sum(a: Column, b: Column, term) -> Column:
    """Sum of term(x, y); vectors of unlike length raise."""
    both = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).when(
        a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vector dimensions differ")).cast("double")
    )


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; a zero vector is at distance 1."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cos = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norms == 0, F.lit(1.0)).otherwise(norms))
    return 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))


METRICS = {"l2": l2, "cosine": cosine, "dot": dot}
