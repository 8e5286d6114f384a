"""Fusing rankings.

A leg is a DataFrame of id and score. Reciprocal ranks, sums and maxima are one union and one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import RequestError

MAX_LEGS, MAX_QUERIES = 16, 16


@dataclass(frozen=True)
class Fusion:
    """``rrf`` with its constant, ``sum`` or ``max``; a weight for each leg, 1 where there are none."""

    kind: str = "rrf"
    k: float = 60.0
    weights: tuple[float, ...] | None = None

    @classmethod
    def parse(cls, raw: dict | None, legs: Sequence[str]) -> Fusion:
        """``raw``: one of {"rrf"|"sum"|"max": {k, weights}}; ``legs``: kinds of the legs."""
        if raw is None:
            return cls()
        if not isinstance(raw, dict) or len(raw) != 1 or next(iter(raw)) not in ("rrf", "sum", "max"):
            raise RequestError("fusion is an object with one of rrf, sum or max")
        ((kind, o),) = raw.items()
        if other := set(o) - {"k", "weights"}:
            raise RequestError(f"fusion: {sorted(other)[0]!r} is not a parameter; k and weights are")
        weights = o.get("weights")
        if weights is not None:
            if len(weights) != len(legs) or any(isinstance(w, bool) or not isinstance(w, (int, float)) or not 0 <= w < float("inf") for w in weights):
                raise RequestError("fusion: weights are finite numbers of at least 0, one for each leg")
            weights = tuple(map(float, weights))
        if kind != "rrf":
            if "k" in o:
                raise RequestError(f"fusion: k is rrf's parameter, not {kind}'s")
            if set(legs) & {"dense", "multi"} or ("sparse" in legs and len(legs) > 1):
                raise RequestError(f"fusion: {kind} combines the scores of text legs, or of a sparse leg alone")
            if kind == "max" and weights is not None and not any(weights):
                raise RequestError("fusion: max with every weight 0 ranks nothing")
        k = float(o.get("k", 60.0))
        if k <= 0:
            raise RequestError("fusion: k is above 0")
        return cls(kind, k, weights)

    @property
    def uncut(self) -> bool:
        """Whether every row that any leg scores takes part: so for sums."""
        return self.kind == "sum"


def top(leg: DataFrame, limit: int) -> DataFrame:
    return leg.orderBy(F.col("score").desc(), F.col("id").asc()).limit(limit)


def fuse(legs: Sequence[DataFrame], how: Fusion, limit: int | None) -> DataFrame:
    """id, score: every id of any leg (cut to ``limit`` but for sums), in no order."""
    if not 1 <= len(legs) <= MAX_LEGS:
        raise RequestError(f"a query has 1 to {MAX_LEGS} legs")
    weights = how.weights or (1.0,) * len(legs)
    parts = []
    for leg, w in zip(legs, weights, strict=True):
        leg = leg.select("id", F.col("score").cast("double").alias("score"))
        if limit is not None and not how.uncut:
            leg = top(leg, limit)
        if how.kind == "rrf":
            rank = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id").asc()))  # of at most ``limit`` rows
            part = leg.select("id", (F.lit(w) / (F.lit(how.k) + rank)).alias("part"))
        else:
            part = leg.select("id", (F.lit(w) * F.col("score")).alias("part"))
        parts.append(part)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg((F.max if how.kind == "max" else F.sum)("part").alias("score"))


def rerank(results: Sequence[DataFrame], k: float = 60.0, weights: Sequence[float] | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Reciprocal ranks over the results of whole queries, which have id and rank (from 1): id, score, ties by id."""
    if not 1 <= len(results) <= MAX_QUERIES:
        raise RequestError(f"1 to {MAX_QUERIES} queries")
    weights = [1.0] * len(results) if weights is None else list(weights)
    if len(weights) != len(results) or k <= 0:
        raise RequestError("a weight for each query, and a constant above 0")
    both = None
    for r, w in zip(results, weights, strict=True):
        part = r.select("id", (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    out = both.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.col("score").desc(), F.col("id").asc())
    return (out.offset(offset) if offset else out).limit(limit)
