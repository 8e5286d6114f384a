"""Grouped aggregation.

``aggregate_by``: label to ``["Count"]``, ``["Count", a]``, ``["Sum"|"Min"|"Max"|"Avg", a]`` or
``["Min"|"Max", a, {"non_numeric": true}]``. ``group_by``: attribute names, or one-entry objects
``{name: ["ForEachUnique", a]}`` and ``{name: ["Bucket", a, width]}``. Everything is one hash aggregate with partial
sums before its shuffle; the groups with the smallest keys are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import INTEGRAL, Attribute, RequestError, group_key, kind_of, unused

MAX_LABELS, MAX_KEYS, MAX_GROUPS = 16, 8, 10_000


def _sum(a: Attribute | None) -> Column:
    """Integers are added exactly, as decimals of 38 digits; with any float the sum is a double, of whose parts those
    that are integers are added exactly first. No numbers: 0."""
    if a is None:
        return F.lit(0)
    if isinstance(a.type, (*INTEGRAL, T.DecimalType)):
        return F.coalesce(F.sum(a.column.cast("decimal(38,0)") if isinstance(a.type, INTEGRAL) else a.column), F.lit(0))
    if a.is_variant:
        kind = kind_of(a.column)
        of = lambda name, as_: F.sum(F.when(kind == name, F.try_variant_get(a.column, "$", as_)))
        return F.coalesce(of("int", "decimal(38,0)").cast("double"), F.lit(0.0)) + F.coalesce(of("float", "double"), F.lit(0.0))
    number = a.number()
    if number is None:
        return F.lit(0)
    return F.coalesce(F.sum(number), F.lit(0.0))


def _extreme(a: Attribute | None, least: bool, non_numeric: bool) -> Column:
    pick = F.min if least else F.max
    if a is None:
        return F.lit(None)
    if a.is_number:
        return pick(a.column)
    if a.is_variant:
        out = pick(a.number())
        if not non_numeric:
            return out
        kind, c = kind_of(a.column), a.column
        text = [F.when(kind == k, F.try_variant_get(c, "$", "string")) for k in ("boolean", "instant", "string")]
        firsts = [pick(t) for t in (text if least else text[::-1])]
        return F.coalesce(out.cast("string"), *firsts)
    return pick(a.column) if non_numeric and not a.is_array else F.lit(None)


def measure(df: DataFrame, spec: Sequence) -> Column:
    """One aggregate of a specification."""
    if not isinstance(spec, (list, tuple)) or not spec:
        raise RequestError("an aggregate is an array")
    fn, *args = spec
    options = args.pop() if args and isinstance(args[-1], dict) else {}
    if fn == "Count":
        if not args or args == ["id"]:
            return F.count(F.lit(1))
        a = Attribute.of(df, args[0])
        return F.count(a.column) if a is not None else F.count(F.lit(None))
    if fn not in ("Sum", "Min", "Max", "Avg") or len(args) != 1:
        raise RequestError(f"{fn!r} is not an aggregate; Count, Sum, Min, Max and Avg are")
    if options and (fn not in ("Min", "Max") or set(options) != {"non_numeric"}):
        raise RequestError("non_numeric is an option of Min and Max")
    a = Attribute.of(df, args[0])
    if fn == "Sum":
        return _sum(a)
    if fn == "Avg":
        number = a.number() if a is not None else None
        return F.avg(number) if number is not None else F.lit(None).cast("double")
    return _extreme(a, fn == "Min", bool(options.get("non_numeric")))


def bucket(a: Attribute, width) -> Column:
    """The lower bound of the value's bucket; NULL for what isn't a number."""
    if isinstance(width, bool) or not isinstance(width, (int, float)) or width <= 0:
        raise RequestError("a bucket's width is a number above 0")
    if isinstance(a.type, INTEGRAL) and isinstance(width, int):
        return a.column - F.pmod(a.column, F.lit(width))
    number = a.number()
    if number is None:
        return F.lit(None).cast("double")
    ratio = number / F.lit(float(width))  # from 2**53 on it is whole, and floor's integers would end at 2**63
    return F.when(F.abs(ratio) < F.lit(2.0**53), F.floor(ratio).cast("double")).otherwise(ratio) * F.lit(float(width))


def _keys(df: DataFrame, group_by: Sequence) -> tuple[DataFrame, list[str], list[str]]:
    if not 1 <= len(group_by) <= MAX_KEYS:
        raise RequestError(f"group_by has 1 to {MAX_KEYS} keys")
    names, exploded, own = [], None, unused(df.columns, "_key_")
    added: dict[str, Column] = {}
    for k in group_by:
        if isinstance(k, str):
            a, name, how = Attribute.of(df, k), k, None
            key = group_key(a) if a is not None else F.lit(None).cast("string")
        else:
            (name, (how, attr, *args)), = k.items()
            a = Attribute.of(df, attr)
            if how == "ForEachUnique":
                if exploded is not None:
                    raise RequestError("a query has one ForEachUnique")
                key = a.column if a is not None else F.lit(None).cast("string")
                exploded = name if a is not None and a.is_array else ""
            elif how == "Bucket":
                key = bucket(a, args[0]) if a is not None else F.lit(None).cast("double")
            else:
                raise RequestError(f"{how!r} is not a way to group; ForEachUnique and Bucket are")
        if name in names:
            raise RequestError("group_by has each name once")
        names.append(name)
        added[f"{own}{len(names)}"] = key
    out = df.withColumns(added)
    if exploded:
        at = f"{own}{names.index(exploded) + 1}"
        out = out.withColumn(at, F.explode_outer(F.array_distinct(at)))  # empty and absent arrays: one row of NULL
    return out, names, [*added]


def aggregate(df: DataFrame, aggregate_by: Mapping[str, Sequence], group_by: Sequence | None = None, top_k: int = 10) -> DataFrame:
    """The labels' values: one row without ``group_by``, even of no rows; else a row a group, ``top_k`` groups at most,
    those with the smallest keys (absent last)."""
    if not 1 <= len(aggregate_by) <= MAX_LABELS:
        raise RequestError(f"aggregate_by has 1 to {MAX_LABELS} labels")
    if not 1 <= top_k <= MAX_GROUPS:
        raise RequestError(f"top_k is from 1 to {MAX_GROUPS}")
    if not group_by:
        return df.agg(*[measure(df, s).alias(label) for label, s in aggregate_by.items()])
    keyed, names, keys = _keys(df, group_by)
    out = keyed.groupBy(*keys).agg(*[measure(df, s).alias(label) for label, s in aggregate_by.items()])
    out = out.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(top_k)
    return out.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(f"`{x}`") for x in aggregate_by])


def facets(df: DataFrame, spec: Mapping) -> DataFrame:
    """Counts beside a ranked query, over the filtered rows and not over its hits."""
    if other := set(spec) - {"aggregate_by", "group_by", "top_k"}:
        raise RequestError(f"facets: {sorted(other)[0]!r} is not a field")
    return aggregate(df, spec.get("aggregate_by", {"count": ["Count"]}), spec["group_by"], spec.get("top_k", 10))


