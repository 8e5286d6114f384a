"""Values of attributes: two-valued tests, exact comparison, sort keys and group keys.

An attribute is a column of one type, or a VARIANT column whose rows hold values of several types. NULL means that the
row lacks it. A test never gives NULL, and a comparison of unlike types is false.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RFC3339 = re.compile(r"^(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?([Zz]|[+-]\d\d:\d\d)$")
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


class RequestError(ValueError):
    """A request that the engine refuses, with the reason."""


def holds(test: Column) -> Column:
    """The test as two-valued logic: false where it is unknown."""
    return F.coalesce(test, F.lit(False))


def parse_instant(text: str) -> dt.datetime | None:
    """An RFC 3339 instant in UTC, of microseconds; None for any other text."""
    m = RFC3339.match(text)
    if not m:
        return None
    y, mo, d, h, mi, s, frac, zone = m.groups()
    try:
        at = dt.datetime(int(y), int(mo), int(d), int(h), int(mi), int(s), int((frac or "").ljust(6, "0")))
    except ValueError:
        return None
    if zone not in "Zz":
        sign = -1 if zone[0] == "-" else 1
        at -= sign * dt.timedelta(hours=int(zone[1:3]), minutes=int(zone[4:6]))
    return at


def instant(at: dt.datetime) -> Column:
    """A UTC instant as a timestamp, whatever the session's time zone."""
    return F.lit(at.replace(tzinfo=None).isoformat(" ") + "Z").cast("timestamp")


INSTANTS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def format_instant(c: Column) -> Column:
    """RFC 3339 text in UTC, without trailing zeros of the fraction."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(whole, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("Z"))


@dataclass(frozen=True)
class Attribute:
    """A column and its type."""

    name: str
    column: Column
    type: T.DataType

    @classmethod
    def of(cls, df: DataFrame, name: str) -> Attribute | None:
        """The attribute of that name, or None: a name that no row has is absent everywhere."""
        if not name or name.startswith("$"):
            raise RequestError(f"{name!r}: an attribute's name is not empty and doesn't begin with $")
        for f in df.schema.fields:
            if f.name == name:
                return cls(name, F.col(f"`{name}`"), f.dataType)
        return None

    @property
    def is_variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, (*INTEGRAL, *FLOATING, T.DecimalType))

    def element(self) -> Attribute:
        return Attribute(self.name, self.column, self.type.elementType)

    def number(self) -> Column | None:
        """The value as a double, NULL where it isn't a number; None for a type that never is."""
        if self.is_number:
            return self.column.cast("double")
        if self.is_variant:
            return F.when(kind_of(self.column).isin("int", "float"), F.try_variant_get(self.column, "$", "double"))
        return None


def kind_of(v: Column) -> Column:
    """int, float, string, boolean, instant, array, other, or NULL, of a VARIANT."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), F.lit(None))
        .when(s.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "int")
        .when(s.startswith("DECIMAL") | s.isin("FLOAT", "DOUBLE"), "float")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("TIMESTAMP"), "instant")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("other")
    )


def _against(value: Column, op: str, literal) -> Column:
    return {"Eq": value == literal, "Lt": value < literal, "Lte": value <= literal, "Gt": value > literal, "Gte": value >= literal}[op]


def _integers(value: Column, op: str, x) -> Column:
    """An integer column against a number, exactly: a fraction moves to the next integer on the side of the test."""
    if isinstance(x, float):
        if math.isinf(x) or math.isnan(x):
            return F.lit(False) if math.isnan(x) or op == "Eq" else F.lit((x > 0) == (op in ("Lt", "Lte"))) & value.isNotNull()
        if x != math.floor(x):
            if op == "Eq":
                return F.lit(False)
            x, op = (math.floor(x), "Lte") if op in ("Lt", "Lte") else (math.ceil(x), "Gte")
    x = int(x)
    if -(2**63) <= x < 2**63:
        return _against(value, op, F.lit(x))
    return F.lit(False) if op == "Eq" else F.lit((x > 0) == (op in ("Lt", "Lte"))) & value.isNotNull()


def _floats(value: Column, op: str, x) -> Column:
    """A floating column against a number, exactly: an integer between two doubles moves to the next one."""
    if isinstance(x, float):
        return _against(value, op, F.lit(x))
    near = float(x)
    if int(near) == x:
        return _against(value, op, F.lit(near))
    if op == "Eq":
        return F.lit(False)
    below = op in ("Lt", "Lte")
    if int(near) > x:
        return value < F.lit(near) if below else value >= F.lit(near)
    return value <= F.lit(near) if below else value > F.lit(near)


def _present(c: Column, test: Column) -> Column:
    """A test that is false where the value is absent, in a form that scans understand."""
    return c.isNotNull() & test


def compare(a: Attribute, op: str, literal) -> Column:
    """Whether the value stands in the relation ``op`` (Eq, Lt, Lte, Gt, Gte) to the literal; false for unlike types."""
    c, t = a.column, a.type
    number = isinstance(literal, (int, float)) and not isinstance(literal, bool)
    if isinstance(t, T.VariantType):
        kind = kind_of(c)
        get = lambda as_: F.try_variant_get(c, "$", as_)
        if number:
            return holds(F.when(kind == "int", _integers(get("bigint"), op, literal)).when(kind == "float", _floats(get("double"), op, literal)))
        if isinstance(literal, bool):
            return holds((kind == "boolean") & _against(get("boolean"), op, F.lit(literal)))
        if isinstance(literal, str):
            at = parse_instant(literal)
            test = (kind == "string") & _against(get("string"), op, F.lit(literal))
            return holds(test | ((kind == "instant") & _against(get("timestamp"), op, instant(at)))) if at else holds(test)
        return F.lit(False)
    if isinstance(t, INTEGRAL) and number:
        return _present(c, _integers(c, op, literal))
    if isinstance(t, FLOATING) and number:
        return _present(c, _floats(c.cast("double"), op, literal))
    if isinstance(t, T.DecimalType) and number:
        if not abs(literal) < 1e28:  # infinite, not a number, or beyond the literal's 38 digits
            return _present(c, _floats(c.cast("double"), op, float(literal)))
        return _present(c, _against(c, op, F.lit(Decimal(literal)).cast("decimal(38,10)")))
    if isinstance(t, T.BooleanType) and isinstance(literal, bool):
        return _present(c, _against(c, op, F.lit(literal)))
    if isinstance(t, T.StringType) and isinstance(literal, str):
        return _present(c, _against(c, op, F.lit(literal)))
    if isinstance(t, INSTANTS) and isinstance(literal, (str, dt.datetime)):
        at = parse_instant(literal) if isinstance(literal, str) else literal
        if at is None:
            return F.lit(False)
        if isinstance(t, T.TimestampNTZType):  # a plain comparison, which reaches the scan
            return _present(c, _against(c, op, F.lit(at.isoformat(" ")).cast("timestamp_ntz")))
        return _present(c, _against(c if isinstance(t, T.TimestampType) else c.cast("timestamp"), op, instant(at)))
    if isinstance(t, T.BinaryType) and isinstance(literal, (str, bytes)):
        return _present(c, _against(c, op, F.unbase64(F.lit(literal)) if isinstance(literal, str) else F.lit(literal)))
    return F.lit(False)


def sort_keys(a: Attribute, descending: bool) -> list[Column]:
    """Keys to order by: absent last in both directions; of unlike types, the type first, then the value."""
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    c = a.column
    if not a.is_variant:
        return [way(F.to_json(c)) if a.is_array else way(c)]
    kind = kind_of(c)
    rank = F.when(kind == "boolean", 0).when(kind.isin("int", "float"), 1).when(kind == "instant", 2).when(kind == "string", 3).when(kind.isNotNull(), 6)
    get = lambda k, as_: F.when(kind.isin(*k), F.try_variant_get(c, "$", as_))
    return [way(rank), way(get(("boolean",), "boolean")), way(get(("int", "float"), "double")), way(get(("int",), "bigint")), way(get(("instant",), "timestamp")), way(get(("string",), "string"))]


def group_key(a: Attribute) -> Column:
    """A value that groups and orders: 1 and 1.0 of a VARIANT are one; absent is NULL."""
    if not a.is_variant:
        return a.column
    kind, c = kind_of(a.column), a.column
    number = F.try_variant_get(c, "$", "double")
    return F.when(kind.isNull(), F.lit(None)).otherwise(
        F.struct(
            F.when(kind == "boolean", 0).when(kind.isin("int", "float"), 1).when(kind == "instant", 2).when(kind == "string", 3).otherwise(6).alias("type"),
            F.when(kind.isin("int", "float"), number).alias("number"),
            F.when(~kind.isin("int", "float"), F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))).alias("text"),
        )
    )


def unused(taken, name: str) -> str:
    """A column name that isn't among those ``taken``, and begins none of them."""
    while any(t.startswith(name) for t in taken):
        name += "_"
    return name


def rounded_to_half(c: Column) -> Column:
    """A float array with its components rounded to IEEE half precision."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def half(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return half(c)
