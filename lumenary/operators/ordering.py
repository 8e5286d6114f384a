"""Ordering by attributes, and pages of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Attribute, RequestError, sort_keys

MAX_KEYS, MAX_PAGE = 8, 10_000


def parse_order(rank_by) -> list[tuple[str, bool]]:
    """``[attribute, "asc"|"desc"]`` or a list of such keys: attribute and whether it descends."""
    keys = [rank_by] if rank_by and isinstance(rank_by[0], str) else rank_by
    if not keys or len(keys) > MAX_KEYS:
        raise RequestError(f"rank_by has 1 to {MAX_KEYS} keys")
    out = []
    for k in keys:
        if not (isinstance(k, (list, tuple)) and len(k) == 2 and k[1] in ("asc", "desc")):
            raise RequestError('a key is [attribute, "asc"|"desc"]')
        out.append((k[0], k[1] == "desc"))
    names = [n for n, _ in out]
    if len(set(names)) < len(names):
        raise RequestError("rank_by names an attribute once")
    if "id" in names[:-1]:
        raise RequestError("id stands last, as it leaves nothing to order")
    return out


def order_keys(df: DataFrame, keys: Sequence[tuple[str, bool]], id_column: str = "id") -> list[Column]:
    """Columns to order by: absent last in both directions, ties by id ascending."""
    out: list[Column] = []
    for name, descending in keys:
        a = Attribute.of(df, id_column if name == "id" else name)
        if a is not None:
            out += sort_keys(a, descending)
    if not keys or keys[-1][0] != "id":
        out.append(F.col(f"`{id_column}`").asc())
    return out


def page(df: DataFrame, order: Sequence[Column], top_k: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + top_k - 1 of the order. Both are bounded, so Spark keeps a heap per task and no sort."""
    if top_k < 0 or offset < 0 or top_k + offset > MAX_PAGE:
        raise RequestError(f"top_k + offset is at most {MAX_PAGE}")
    return df.orderBy(*order).offset(offset).limit(top_k) if offset else df.orderBy(*order).limit(top_k)


def after(df: DataFrame, cursor, top_k: int, id_column: str = "id") -> DataFrame:
    """The page that follows an id: a range on the id, which the scan can use, and a bounded order."""
    rows = df if cursor is None else df.filter(F.col(f"`{id_column}`") > F.lit(cursor))
    return page(rows, [F.col(f"`{id_column}`").asc()], top_k)
