"""What happens to a window of ranked candidates: boosts, diversity, a limit for each group, the page."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.values import INSTANTS, Attribute, RequestError, compare, group_key, instant, parse_instant, unused

MAX_TERMS, MAX_WINDOW = 8, 1000


def window_of(top_k: int, asked: int | None = None) -> int:
    """Candidates that are re-scored: twice the page, within 100 and 1,000."""
    if asked is None:
        return min(MAX_WINDOW, max(100, 2 * top_k))
    if not 1 <= asked <= MAX_WINDOW:
        raise RequestError(f"window is from 1 to {MAX_WINDOW}")
    return asked


def boost_term(df: DataFrame, term: dict) -> Column:
    """What one term adds: weight times its function of an attribute, 0 where the attribute has no value for it.

    Functions: "linear"; {"saturate": {"pivot"}}; {"decay": {"origin", "scale", "shape"}}; {"eq": {"value"}}.
    """
    if set(term) - {"attr", "fn", "weight"} or not {"attr", "fn"} <= set(term):
        raise RequestError("a boost term has attr, fn and weight")
    a, fn, weight = Attribute.of(df, term["attr"]), term["fn"], float(term.get("weight", 1.0))
    name, o = (fn, {}) if isinstance(fn, str) else next(iter(fn.items()))
    if name not in ("linear", "saturate", "decay", "eq"):
        raise RequestError(f"{name!r} is not a boost; linear, saturate, decay and eq are")
    if a is None:
        return F.lit(0.0)
    number = a.number()
    if name == "eq":
        test = F.exists(a.column, lambda x: compare(Attribute(a.name, x, a.type.elementType), "Eq", o["value"])) if a.is_array else compare(a, "Eq", o["value"])
        value = F.when(F.coalesce(test, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
    elif name == "decay":
        value = _decay(a, o)
    elif number is None:
        return F.lit(0.0)
    elif name == "linear":
        value = number
    else:
        pivot = float(o["pivot"])
        if pivot <= 0:
            raise RequestError("pivot is above 0")
        up = F.greatest(number, F.lit(0.0))
        value = up / (up + F.lit(pivot))
    return F.coalesce(F.nanvl(F.lit(weight) * value, F.lit(0.0)), F.lit(0.0))


def _decay(a: Attribute, o: dict) -> Column:
    """1 at the origin and 1/2 at ``scale`` from it: exp 0.5^r, gauss 0.5^(r^2), linear max(1 - r/2, 0)."""
    scale, shape, origin = float(o["scale"]), o.get("shape", "exp"), o["origin"]
    if scale <= 0 or shape not in ("exp", "gauss", "linear"):
        raise RequestError("decay takes a scale above 0 and the shape exp, gauss or linear")
    if isinstance(origin, str):
        at = parse_instant(origin)
        if at is None:
            raise RequestError(f"{origin!r} is not an instant")
        if not isinstance(a.type, INSTANTS):
            return F.lit(None).cast("double")
        far = F.abs(F.unix_micros(a.column.cast("timestamp")) - F.unix_micros(instant(at))) / F.lit(1e6)
    elif isinstance(origin, (list, tuple)):
        if not a.is_array:
            return F.lit(None).cast("double")
        lat, lon, ok = geo.point(a.column)
        far = F.when(ok, geo.haversine(lat, lon, *map(float, origin)))
    else:
        n = a.number()
        if n is None:
            return F.lit(None).cast("double")
        far = F.abs(n - F.lit(float(origin)))
    r = far / F.lit(scale)
    if shape == "linear":
        return F.greatest(F.lit(1.0) - r / 2, F.lit(0.0))
    return F.pow(F.lit(0.5), r if shape == "exp" else r * r)


def boosted(df: DataFrame, terms: Sequence[dict]) -> DataFrame:
    """Candidates with the terms added to their scores."""
    if not 1 <= len(terms) <= MAX_TERMS:
        raise RequestError(f"boost has 1 to {MAX_TERMS} terms")
    score = F.col("score").cast("double")
    for t in terms:
        score = score + boost_term(df, t)
    return df.withColumn("score", score)


def _mmr(pdf: pd.DataFrame, vector: str, weight: float) -> pd.DataFrame:
    """Greedy order: weight times relevance (scaled to 0..1) less (1 - weight) times the largest cosine to what stands
    before; ties to the earlier candidate. Vectors of another width than the first one's are like none."""
    pdf = pdf.sort_values("rank").reset_index(drop=True)
    n = len(pdf)
    rel = pdf["score"].to_numpy(float)
    spread = rel.max() - rel.min() if n else 0.0
    rel = (rel - rel.min()) / spread if spread > 0 else np.ones(n)
    width = next((len(v) for v in pdf[vector] if v is not None), 1)
    v = np.stack([np.zeros(width) if x is None or len(x) != width else np.asarray(x, float) for x in pdf[vector]]) if n else np.zeros((0, width))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    left, near, order = np.ones(n, bool), np.full(n, -np.inf), []
    for _ in range(n):
        value = weight * rel - (1 - weight) * np.where(np.isfinite(near), near, 0.0)
        best = int(np.argmax(np.where(left, value, -np.inf)))
        order.append(best)
        left[best] = False
        near = np.maximum(near, v @ v[best])
    out = pdf.iloc[order].copy()
    out["rank"] = np.arange(1, n + 1)
    return out


def diversified(df: DataFrame, vector: str, weight: float) -> DataFrame:
    """Candidates (id, score, rank and ``vector``, at most MAX_WINDOW of them) in the order of maximal marginal
    relevance. The order of each depends on all before, so they are one bounded group."""
    if not 0 <= weight <= 1:
        raise RequestError("diversify's lambda is from 0 to 1")
    rows = df.orderBy("rank").limit(MAX_WINDOW)
    schema = T.StructType([T.StructField(f.name, T.IntegerType() if f.name == "rank" else f.dataType) for f in df.schema.fields])

    def ordered(batches):
        held = list(batches)
        if held:
            yield _mmr(pd.concat(held, ignore_index=True), vector, weight)

    return rows.withColumn("rank", F.col("rank").cast("int")).coalesce(1).mapInPandas(ordered, schema)


def limited(df: DataFrame, attributes: Sequence[str], limit: int) -> DataFrame:
    """At most ``limit`` candidates of each group, in their order (rank)."""
    if not 1 <= len(attributes) <= MAX_TERMS or limit < 1:
        raise RequestError(f"limit_per takes 1 to {MAX_TERMS} attributes and a limit of 1 at least")
    keys = [group_key(a) if (a := Attribute.of(df, n)) is not None else F.lit(None).cast("string") for n in attributes]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    name = unused(df.columns, "_place")
    return df.withColumn(name, place).filter(F.col(name) <= limit).drop(name)
