"""Vectors as arrays of floats: products, distances and fixed-dimensional encodings of sets of vectors.

Sums are built-in higher-order functions over doubles, so that they stay in the JVM; an encoding of sets is one
Arrow-batched function.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("dot_product", "cosine_distance", "euclidean_squared")


def literal(v: Sequence[float]) -> Column:
    """A query vector."""
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def query_score(a: Column, query: Sequence[float], metric: str) -> Column:
    """``score`` against a query vector, whose own norm is worked out once."""
    if metric != "cosine_distance":
        return score(a, literal(query), metric)
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    return dot(a, literal([x / norm for x in query])) / F.nullif(F.sqrt(norm_squared(a)), F.lit(0.0))


def norm_squared(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of the angle; NULL where a vector is zero."""
    n = F.sqrt(norm_squared(a)) * F.sqrt(norm_squared(b))
    return F.when(n > 0, dot(a, b) / n)


def score(a: Column, b: Column, metric: str) -> Column:
    """What is ranked by, largest first."""
    if metric == "dot_product":
        return dot(a, b)
    if metric == "cosine_distance":
        return cosine(a, b)
    if metric == "euclidean_squared":
        return -squared_distance(a, b)
    raise ValueError(f"{metric!r} is not a metric; {', '.join(METRICS)} are")


def distance(s: Column, metric: str) -> Column:
    """The distance that goes with a score: -dot, 1 - cosine within 0 and 2, or the squared distance."""
    if metric == "dot_product":
        return -s
    if metric == "cosine_distance":
        return F.when(s.isNotNull(), F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.lit(1.0) - s)))
    return F.when(s.isNotNull(), F.greatest(F.lit(0.0), -s))


def max_sim(vectors: Column, query: Sequence[Sequence[float]]) -> Column:
    """The sum over the query's vectors of the largest product with a vector of the row; NULL for a row without any."""
    with_ = lambda q: lambda d: dot(d, literal(q))
    each = [F.array_max(F.transform(vectors, with_(q))) for q in query]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return F.when(F.size(vectors) > 0, total)


@dataclass(frozen=True)
class SetEncoding:
    """``reps`` partitions of space by ``bits`` random planes; each of the 2**bits cells is projected to ``width``
    dimensions by random signs. A document's cell is the mean of its vectors there (an empty one takes the vector whose
    cell differs in the fewest bits), a query's the sum, so that the product of encodings estimates ``max_sim``."""

    reps: int = 4
    bits: int = 3
    width: int = 16
    seed: int = 20_240_501

    def draws(self, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Planes and signs of each partition, a function of the seed and the dimension alone."""
        out = []
        for r in range(self.reps):
            rng = np.random.default_rng([self.seed, r, dim])
            out.append((rng.standard_normal((dim, self.bits)), rng.choice([-1.0, 1.0], (dim, self.width))))
        return out

    def encode(self, vectors: Sequence[Sequence[float]], document: bool) -> np.ndarray:
        """The encoding of one set; empty for an empty set."""
        if vectors is None or len(vectors) == 0:
            return np.zeros(0, np.float32)
        v = np.stack([np.asarray(x, float) for x in vectors])
        powers, cells, parts = 1 << np.arange(self.bits), 1 << self.bits, []
        for planes, signs in self.draws(v.shape[1]):
            cell = (v @ planes > 0) @ powers
            acc = np.zeros((cells, v.shape[1]))
            np.add.at(acc, cell, v)
            if document:
                n = np.bincount(cell, minlength=cells)
                acc /= np.maximum(n, 1)[:, None]
                for c in np.flatnonzero(n == 0):
                    acc[c] = v[min(range(len(v)), key=lambda i: (int(cell[i] ^ c).bit_count(), i))]
            parts.append((acc @ signs / self.width**0.5).ravel())
        return np.concatenate(parts).astype(np.float32)

    def column(self, vectors: Column) -> Column:
        """The encodings of documents."""
        own = self

        @F.pandas_udf("array<float>")
        def encoded(sets: pd.Series) -> pd.Series:
            return sets.map(lambda x: own.encode(x, True))

        return encoded(vectors)


def from_bytes(c: Column) -> Column:
    """Little-endian 32-bit floats (a fixed-length binary column) as an array."""

    @F.pandas_udf("array<float>")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return decoded(c)


def to_base64(c: Column) -> Column:
    """An array of floats as base64 of little-endian 32-bit floats."""
    import base64

    @F.pandas_udf("string")
    def encoded(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())

    return encoded(c)
