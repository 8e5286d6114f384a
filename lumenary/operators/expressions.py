"""Scoring expressions to columns.

``["Sum"|"Max", [e, ...]]``, ``["Product", weight, e]``, ``["Attribute", a]``, ``["Saturate"|"Decay", e, {midpoint,
exponent}]``, ``["Dist", ["Attribute", a], origin]``, ``[field, "BM25", query]``, a number, or a filter clause (1 or 0).
A part without a value counts as 0 in sums. Rows are ranked by scores above 0 alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import INSTANTS, Attribute, RequestError, instant, parse_instant
from .predicates import Filters

MAX_NODES, MAX_DEPTH, LARGEST = 64, 8, 1e30
UNIT_MS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(v) -> float:
    """A number, or a text such as "6h" in milliseconds."""
    if isinstance(v, str):
        m = re.fullmatch(r"(\d+(?:\.\d+)?)([smhdw])", v)
        if not m:
            raise RequestError(f"{v!r} is not a duration; a number and one of s, m, h, d, w is")
        return float(m[1]) * UNIT_MS[m[2]]
    return float(v)


class Expressions:
    """Turns expressions into columns over one DataFrame; ``bm25(field, query, options)`` gives the column of a text
    part."""

    def __init__(self, df: DataFrame, filters: Filters, bm25: Callable[[str, str, dict], Column] | None = None):
        self.df, self.filters, self.bm25 = df, filters, bm25
        self.nodes = 0

    def column(self, e, ranks: bool = True) -> Column:
        """The value as a double, NULL where undefined. What ranks must be non-negative by its form."""
        self.nodes = 0
        if ranks and self.signed(e):
            raise RequestError("a ranked expression is never negative: an Attribute, a signed weight or number needs Saturate or Decay around it")
        return self._node(e, 1)

    def signed(self, e) -> bool:
        """Whether the form allows a negative value."""
        if isinstance(e, (int, float)) and not isinstance(e, bool):
            return e < 0
        if isinstance(e, (list, tuple)) and e:
            if e[0] == "Attribute":
                return True
            if e[0] in ("Sum", "Max") and len(e) == 2:
                return any(self.signed(x) for x in e[1])
            if e[0] == "Product" and len(e) == 3:
                return any(self.signed(x) for x in e[1:])
        return False

    def _node(self, e, depth: int) -> Column:
        self.nodes += 1
        if self.nodes > MAX_NODES or depth > MAX_DEPTH:
            raise RequestError(f"an expression has at most {MAX_NODES} parts and depth {MAX_DEPTH}")
        if isinstance(e, (int, float)) and not isinstance(e, bool):
            if abs(e) > LARGEST:
                raise RequestError(f"a number is at most {LARGEST}")
            return F.lit(float(e))
        if not isinstance(e, (list, tuple)) or not e:
            raise RequestError("an expression is an array or a number")
        kind = e[0]
        if kind in ("Sum", "Max") and len(e) == 2 and isinstance(e[1], (list, tuple)) and e[1]:
            parts = [F.coalesce(self._node(x, depth + 1), F.lit(0.0)) for x in e[1]]
            return reduce(lambda a, b: a + b, parts) if kind == "Sum" else (F.greatest(*parts) if len(parts) > 1 else parts[0])
        if kind == "Product" and len(e) == 3:
            weight, part = (e[1], e[2]) if isinstance(e[1], (int, float)) else (e[2], e[1])
            if isinstance(weight, bool) or not isinstance(weight, (int, float)) or not (weight == 0 or 1e-3 <= abs(weight) <= 1e3):
                raise RequestError("a Product's weight is 0, or from 0.001 to 1000")
            return F.lit(float(weight)) * self._node(part, depth + 1)
        if kind == "Attribute" and len(e) == 2:
            a = Attribute.of(self.df, e[1])
            n = a.number() if a is not None else None
            return F.lit(None).cast("double") if n is None else F.when(n.isNotNull(), F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), n)))
        if kind in ("Saturate", "Decay") and len(e) == 3:
            return self._curve(kind, self._node(e[1], depth + 1), e[2])
        if kind == "Dist" and len(e) == 3:
            return self._distance(e[1], e[2])
        if len(e) >= 3 and e[1] == "BM25":
            if self.bm25 is None:
                raise RequestError("BM25 needs a text field")
            return self.bm25(e[0], e[2], e[3] if len(e) > 3 else {})
        return self.filters.column(e).cast("double")

    def _curve(self, kind: str, x: Column, o: dict) -> Column:
        """1 / (1 + (m / x)^p) or 1 / (1 + (x / m)^p) over x of at least 0; undefined: 0."""
        if set(o) - {"midpoint", "exponent"} or "midpoint" not in o:
            raise RequestError(f"{kind} takes midpoint and exponent")
        m, p = duration_ms(o["midpoint"]), float(o.get("exponent", 1))
        if m <= 0 or p <= 0:
            raise RequestError("midpoint and exponent are above 0")
        up = F.greatest(x, F.lit(0.0))
        if kind == "Decay":
            return F.when(x.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.pow(up / F.lit(m), F.lit(p)))).otherwise(F.lit(0.0))
        return F.when(up > 0, F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(m) / F.nullif(up, F.lit(0.0)), F.lit(p)))).otherwise(F.lit(0.0))

    def _distance(self, attribute, origin) -> Column:
        """|x - origin| of numbers, or milliseconds between instants."""
        if not (isinstance(attribute, (list, tuple)) and len(attribute) == 2 and attribute[0] == "Attribute"):
            raise RequestError('Dist takes ["Attribute", name] and an origin')
        a = Attribute.of(self.df, attribute[1])
        if a is None:
            return F.lit(None).cast("double")
        if isinstance(origin, str):
            at = parse_instant(origin)
            if at is None:
                raise RequestError(f"{origin!r} is not an instant")
            if not isinstance(a.type, INSTANTS):
                return F.lit(None).cast("double")
            return F.abs(F.unix_micros(a.column.cast("timestamp")) - F.unix_micros(instant(at))) / F.lit(1000.0)
        n = a.number()
        return F.lit(None).cast("double") if n is None else F.abs(n - F.lit(float(origin)))


def ranked(df: DataFrame, score: Column, top_k: int, offset: int = 0, id_column: str = "id") -> DataFrame:
    """Rows with a score above 0, the largest first, ties by id."""
    from .ordering import page

    out = df.withColumn("score", score).filter(F.col("score") > 0)
    return page(out, [F.col("score").desc(), F.col(f"`{id_column}`").asc()], top_k, offset)
