"""Column expressions on array columns: filling, casting, distances."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the distances and of the loss in the model library.
PAIRWISE_EPS = 1e-6
COSINE_EPS = 1e-8
TRIPLET_MARGIN = 5.0
GRAPH_DIM = 200
WEIGHT_DIM = 100


def zero_fill(vector: Column, dim: int = GRAPH_DIM, zero: str | float = "0.0") -> Column:
    """A missing vector becomes ``dim`` times ``zero``, a string as in vector files, or a number."""
    return F.coalesce(vector, F.array_repeat(F.lit(zero), dim))


def to_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def even_items(items: Column) -> Column:
    return F.filter(items, lambda _, i: i % 2 == 0)


def odd_items(items: Column) -> Column:
    return F.filter(items, lambda _, i: i % 2 == 1)


def to_weights(items: Column) -> Column:
    """Strings to doubles; what is no number becomes null and is filled by ``finite``."""
    return F.transform(items, lambda x: x.try_cast("double"))


def finite(vector: Column, dim: int = WEIGHT_DIM) -> Column:
    """``dim`` finite numbers: NaN, null and missing items are 0, infinities the largest doubles.

    A longer array is an error, because cutting it would lose numbers.
    """
    top = F.lit(sys.float_info.max)
    # NaN is the greatest value of all, and a comparison with null holds for nothing.
    filled = F.transform(
        vector,
        lambda x: F.when((x >= -top) & (x <= top), x)
        .when(x < -top, -top)
        .when(x == F.lit(float("inf")), top)
        .otherwise(F.lit(0.0)),
    )
    filled = F.coalesce(filled, F.array().cast("array<double>"))
    padded = F.concat(filled, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(filled), F.lit(0))))
    problem = F.concat(F.size(filled).cast("string"), F.lit(f" items where {dim} are expected"))
    return F.when(F.size(filled) > dim, F.raise_error(problem).cast("array<double>")).otherwise(padded)


def features(text: Column, graph: Column | None = None, weights: Column | None = None) -> Column:
    """Text vector, then the optional graph and weight vectors."""
    parts = [v.cast("array<double>") for v in (text, graph, weights) if v is not None]
    return F.concat(*parts)


def _sum(items: Column, term=lambda x: x) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + term(x))


def _same_length(a: Column, b: Column, distance: Column) -> Column:
    """A distance of vectors of unequal length is an error; one of a missing vector is null."""
    problem = F.concat(
        F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" numbers")
    )
    return F.when(F.size(a) != F.size(b), F.raise_error(problem).cast("double")).otherwise(distance)


def _gap(a: Column, b: Column, eps: float) -> Column:
    return F.zip_with(to_doubles(a), to_doubles(b), lambda x, y: x - y + eps)


def euclidean(a: Column, b: Column, eps: float = PAIRWISE_EPS) -> Column:
    return _same_length(a, b, F.sqrt(_sum(_gap(a, b, eps), lambda d: d * d)))


def manhattan(a: Column, b: Column, eps: float = PAIRWISE_EPS) -> Column:
    return _same_length(a, b, _sum(_gap(a, b, eps), F.abs))


def cosine(a: Column, b: Column, eps: float = COSINE_EPS) -> Column:
    """1 - cosine similarity, with each norm at least ``eps``."""
    a, b = to_doubles(a), to_doubles(b)

    def norm(v: Column) -> Column:
        return F.greatest(F.sqrt(_sum(v, lambda x: x * x)), F.lit(eps))

    product = _sum(F.zip_with(a, b, lambda x, y: x * y))
    return _same_length(a, b, 1 - product / (norm(a) * norm(b)))


DISTANCES = {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine}


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows from the first column to the last, as the column expressions add, to the last bit."""
    total = np.zeros(len(x))
    for column in np.ascontiguousarray(x.T):
        total += column
    return total


def _paired(distance):
    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if a.shape != b.shape:
            raise ValueError(f"vectors of {a.shape[1]} and {b.shape[1]} numbers")
        return distance(a, b)

    return run


def _batch_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norms = [np.maximum(np.sqrt(_row_sums(v * v)), COSINE_EPS) for v in (a, b)]
    return 1 - _row_sums(a * b) / (norms[0] * norms[1])


#: The same distances for the rows of two matrices.
BATCH_DISTANCES = {
    "euclidean": _paired(lambda a, b: np.sqrt(_row_sums((a - b + PAIRWISE_EPS) ** 2))),
    "manhattan": _paired(lambda a, b: _row_sums(np.abs(a - b + PAIRWISE_EPS))),
    "cosine": _paired(_batch_cosine),
}
