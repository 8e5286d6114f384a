"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; what lies between counts as a word. Bytes of it never occur inside a UTF-8 character.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that a worker gets, about, and of a word that it remembers, at most.
BATCH_BYTES, MEMO_WORD = 4 << 20, 64

_memory: dict[tuple, Any] = {}


def memory(*key, make: Callable[[], Any]) -> Any:
    """What this process remembers under ``key``, the operator first. It remembers for one operator at a time: what a
    reused worker still holds of another one goes, so that memories don't add up over a pipeline."""
    if key not in _memory:
        _memory.clear()
        pa.default_memory_pool().release_unused()
        _memory[key] = make()
    return _memory[key]


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, whatever the length of texts; a session's smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", df.sparkSession.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, or the named columns of it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (local runs)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lumenary-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def split_words(text: str) -> list[str]:
    """Words as WORD finds them; str.split knows more kinds of white space, so it is used on bytes only."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower()


def batched(rows: Iterable, size: int):
    """Lists of at most ``size`` items."""
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def row_key() -> Column:
    """A 64-bit key of what the operators read of a document; repeated rows share it."""
    return F.xxhash64("doc_id", "text", "source")


def _of_rows(docs: DataFrame, which: DataFrame, how: str, once: bool = False, *columns: str) -> DataFrame:
    own, key = (f"{n}_{uuid.uuid4().hex}" for n in ("id", "key"))  # no column of docs has these names
    keyed = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), key: row_key()})
    which = which.select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias(own), F.col("row_key").alias(key), *columns)
    which = which.dropDuplicates([own, key]) if columns else which
    out = keyed.join(which, [own, key], how)
    return (out.dropDuplicates([own, key]) if once else out).drop(own, key)


def keep_rows(docs: DataFrame, good: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, row_key) is among those of ``good``, with all columns of ``docs``; repeated
    rows stay repeated, or are one row each if ``once``."""
    return _of_rows(docs, good, "left_semi", once)


def drop_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, row_key) isn't among those of ``bad``."""
    return _of_rows(docs, bad, "left_anti")


def with_values(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, row_key) is among those of ``good``, with its further columns beside them,
    whose names ``docs`` doesn't have and whose values are the same wherever doc_id and row_key are."""
    return _of_rows(docs, good, "inner", False, *(c for c in good.columns if c not in ("doc_id", "row_key")))
