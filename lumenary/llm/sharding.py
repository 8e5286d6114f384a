"""Sharding by extendible hashing.

Every row hashes to 60 bits. A directory starts with one bucket; only a bucket over the byte limit splits, on the next
bit of the hash, until every bucket fits. A bucket is thus a prefix of bits, and its rows are one shard.

The directory is never gathered anywhere: a row's shard is the shortest prefix of its hash whose rows fit the limit, so
the bytes of all prefixes are one grouped sum over fine cells (about ``CELLS_PER_SHARD`` a shard), and a cell takes the
shortest of its prefixes that fits. Cells that no prefix makes small enough go through the same step a few bits deeper.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

BITS = 60
CELLS_PER_SHARD = 16


def row_hash(key: Column, content: Column) -> Column:
    """60 bits of the MD5 of key and content; null counts as a value of its own."""
    whole = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(F.md5(content.cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def assign(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """``rows`` has hash (60 bits) and n_bytes, and any further columns, which stay. Adds shard (the prefix as a string
    of 0 and 1, empty for the whole table), depth (its length) and oversized.

    An empty table gives no rows. A null n_bytes counts as 0. Rows with the same hash share a shard; where they alone
    are over the limit at 60 bits, or a single row is, the shard has the full depth and oversized is true: no hash bit
    can part them. Repeated rows stay repeated.
    """
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    rows = rows.withColumn("n_bytes", F.coalesce(F.col("n_bytes"), F.lit(0)).cast("long"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total) / limit_bytes * CELLS_PER_SHARD + 1))))
    base, left, done = 0, rows, None
    while True:
        cells = left.groupBy(F.shiftright("hash", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("cell_bytes"))
        # A prefix shorter than what the step before has tried is known to be over the limit.
        steps = F.sequence(F.lit(base), F.lit(depth))
        each = cells.select("cell", "cell_bytes", F.explode(steps).alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
        sums = each.groupBy("d", "prefix").agg(F.sum("cell_bytes").alias("prefix_bytes"))
        fits = sums.filter((F.col("prefix_bytes") <= limit_bytes) | (F.col("d") == BITS))
        found = each.join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min("d").cast("int").alias("depth"), F.min(F.struct("d", "prefix_bytes"))["prefix_bytes"].alias("shard_bytes"))
        found = stored(found, "shard-directory")
        here = left.withColumn("cell", F.shiftright("hash", BITS - depth)).join(found, "cell", "left")
        part = here.filter(F.col("depth").isNotNull()).drop("cell")
        done = part if done is None else done.unionByName(part)
        if depth == BITS or cells.join(found, "cell", "left_anti").limit(1).count() == 0:
            break
        left = here.filter(F.col("depth").isNull()).drop("cell", "depth", "shard_bytes")
        base, depth = depth + 1, min(BITS, depth + 8)
    prefix = F.expr(f"substring(lpad(bin(hash), {BITS}, '0'), 1, depth)")
    return done.withColumn("shard", prefix).withColumn("oversized", F.col("shard_bytes") > limit_bytes)


def shard_documents(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8; null: 0), shard, depth, oversized: one row per row of ``docs``, whose
    further columns are not read."""
    keys = stored(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")), "shard-keys")
    return assign(keys, limit_bytes).select("doc_id", "n_bytes", "shard", "depth", "oversized")


def write_shards(docs: DataFrame, limit_bytes: int, path: str) -> DataFrame:
    """Write ``docs`` to ``path``, one folder (shard=...) per shard; returns the assignment, as read from there. A shard
    fits its limit, so one task a shard is bounded by it."""
    keyed = docs.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "hash": row_hash(F.col("doc_id"), F.col("text"))})
    out = assign(keyed, limit_bytes)
    out.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.schema(out.schema).parquet(path).withColumn("shard", F.coalesce("shard", F.lit("")))  # no prefix is the folder of null
    return written.select("doc_id", "n_bytes", "shard", "depth", "oversized")


def output_folder(spark: SparkSession) -> str:
    """A new folder for shards among the shared ones."""
    return f"{shared_dir(spark)}/document-shards-{uuid.uuid4().hex}"


#: Of the registered query's shards: small enough that its directory splits at every size of the tables. A production
#: run passes its own, as 256 MB.
LIMIT_BYTES = 1 << 20

SQL = f"""
WITH keys AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
levels AS (
  SELECT rid, doc_id, n_bytes, h, d, sum(n_bytes) OVER (PARTITION BY d, h >> ({BITS} - d)) AS b
  FROM keys, range(0, {BITS + 1}) r(d)),
least AS (SELECT rid, doc_id, n_bytes, h, min(d) AS depth, arg_min(b, d) AS b FROM levels WHERE b <= {LIMIT_BYTES} OR d = {BITS} GROUP BY ALL)
SELECT doc_id, n_bytes, substr(lpad(format('{{:b}}', h), {BITS}, '0'), 1, depth::INT) AS shard, depth::INT AS depth, b > {LIMIT_BYTES} AS oversized FROM least
"""
