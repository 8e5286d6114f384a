"""Reading vectors and attributes where they lie, and exporting pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..functions.values import RequestError, format_instant
from ..operators.ordering import after

MAX_PAGE, MAX_VECTOR_PAGE, MAX_K, MAX_WINDOW = 10_000, 1_000, 1_000, 10_000


def external(spark: SparkSession, path: str, vector: str, kind: str = "parquet") -> DataFrame:
    """A table of the customer's with a vector column, read in place: a list of numbers, or fixed-length bytes of
    little-endian floats. The other columns stay; only those that a query names are read."""
    if kind == "lance":
        raise RequestError("lance datasets need a reader that isn't installed; parquet is supported")
    if kind != "parquet":
        raise RequestError(f"{kind!r} is not a kind of table; parquet is")
    df = spark.read.parquet(path)
    if vector not in df.columns:
        raise RequestError(f"{vector!r} is not a column of {path}")
    t = df.schema[vector].dataType
    if isinstance(t, T.BinaryType):
        return df.withColumn(vector, vectors.from_bytes(F.col(vector)))
    if not isinstance(t, T.ArrayType) or not isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        raise RequestError(f"{vector!r} holds neither lists of floats nor bytes")
    return df


def search_external(df: DataFrame, vector: str, query, k: int = 10, where: Column | None = None, id_column: str = "id") -> DataFrame:
    """The k rows with the largest cosine, of those that ``where`` admits; ties by id."""
    if not 1 <= k <= MAX_K:
        raise RequestError(f"k is from 1 to {MAX_K}")
    rows = df.filter(where) if where is not None else df
    rows = rows.filter(F.size(vector) == len(query)).withColumn("score", vectors.query_score(F.col(vector), query, "cosine_distance"))
    return rows.filter(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.col(id_column).asc()).limit(k)


def exported(c: Column, t: T.DataType) -> Column:
    """A column as exports write it: integers, doubles, Booleans, strings, instants and bytes as they are, all else as
    JSON text."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(t, T.FloatType):
        return c.cast("double")
    if isinstance(t, T.DecimalType) and t.scale > 0:
        return c.cast("double")
    if isinstance(t, (T.DoubleType, T.DecimalType, T.BooleanType, T.StringType, T.BinaryType, T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(t, T.DateType):
        return c.cast("timestamp")
    return F.to_json(c)


def export_page(df: DataFrame, path: str, cursor=None, limit: int = MAX_PAGE, with_vectors: bool = False, vector_columns=("vector",), id_column: str = "id"):
    """Write the rows that follow ``cursor`` in the order of ids, and return the next cursor (None: no more)."""
    most = MAX_VECTOR_PAGE if with_vectors else MAX_PAGE
    if not 1 <= limit <= most:
        raise RequestError(f"a page has 1 to {most} rows")
    kept = [f for f in df.schema.fields if with_vectors or f.name not in vector_columns]
    rows = after(df, cursor, limit, id_column)
    out = rows.select(*[(F.col(f"`{f.name}`") if f.name in vector_columns else exported(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in kept])
    out.write.mode("overwrite").parquet(path)
    got = df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.max(id_column).alias("last")).first()
    return got["last"] if got["n"] == limit else None


def instants_as_text(df: DataFrame) -> DataFrame:
    """Timestamp columns as RFC 3339 text, for results that go out as JSON."""
    return df.select(*[format_instant(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(f"`{f.name}`") for f in df.schema.fields])
