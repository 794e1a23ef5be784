"""Vector expressions over ``array<float|double>`` columns, in double precision."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 9  # finer differences are summation noise, not order


def literal(values: Sequence, ddl: str = "array<double>") -> Column:
    """A numeric array constant. One JSON text folds to a literal; no call per number."""
    return F.from_json(F.lit(json.dumps(values)), ddl)


def _fold(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def distance(a: Column, b: Column) -> Column:
    def squared(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(_fold(F.zip_with(a, b, squared)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either side has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def cosine_to(a: Column, target: Sequence[float]) -> Column:
    """Cosine to a fixed vector, whose own norm is folded on the driver."""
    target = [float(x) for x in target]
    size = sum(x * x for x in target) ** 0.5
    length = norm(a)
    if size == 0:
        return F.lit(0.0)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, literal(target)) / (length * F.lit(size)))


def mean_vector(a: Column) -> Column:
    """Aggregate: element-wise mean, merged map-side, whatever the group size."""
    return vector_to_array(Summarizer.mean(array_to_vector(a.cast("array<double>"))))
