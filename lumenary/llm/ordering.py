"""Training-order materialisation: token sequences in fixed-stride binary shards.

Texts become one stream of ids per part of the table (each text ends with id 0), cut into sequences of ``seq_len``.
Sequences are numbered from 0 without gaps; a keyed Feistel network over the next power of four, walked along its cycle
until the value is below the number of sequences, is a permutation of those numbers and gives every sequence its slot.
Shards are ranges of slots. Slot s is in shard s // per_shard, at byte (s % per_shard) * stride, so a reader starts
anywhere and reads on in training order. No ordering of all rows is needed, and the order depends on the key alone.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, shared_dir, stored
from .tokens import ids_of, tokenizer, vocabulary

U = np.uint64
END = (0).to_bytes(4, "little")
#: Of an id in a record, for vocabularies of at most 65,536 entries and for larger ones.
ID, WIDE = np.dtype("<u2"), np.dtype("<u4")
#: Parts of the table whose counts are added up together, and parts whose places every task gets at most.
GROUP, BROADCAST_PARTS = 4096, 2_000_000
#: Shards that a task writes, about, however many there are.
TASK_SHARDS = 4


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; Spark's names for S3 are Arrow's s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slots of the numbers ``index`` under the permutation of 0 .. n - 1 that ``key`` selects."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low, shift = U((1 << half) - 1), U(half)
    keys = [U((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & (1 << 64) - 1) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & low
        for k in keys:
            f = (b ^ k) * U(0xFF51AFD7ED558CCD)
            f = (f ^ (f >> U(33))) * U(0xC4CEB9FE1A85EC53)
            a, b = b, a ^ ((f ^ (f >> U(29))) & low)
        return a << shift | b

    out = once(np.asarray(index, U))
    while (over := out >= U(n)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """part, k, n_tokens, doc_ids and the ids, compressed, of each sequence of this part of the table."""
    of, pack, part, k = ids_of(path), zstandard.ZstdCompressor(3), TaskContext.get().partitionId(), 0
    rest, docs, rows = b"", [], []
    stride = seq_len * 4

    def row(cut: bytes, ids: list) -> tuple:
        return part, k, len(cut) // 4, ids, pack.compress(np.frombuffer(cut, "<u4").astype(dtype).tobytes())

    def batch(rows: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "k", "n_tokens", "doc_ids", "packed"])

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            t = text.as_py()
            rest += (of.text(t) if t else b"") + END
            docs.append(doc_id)
            at = 0
            while len(rest) - at >= stride:
                rows.append(row(rest[at : at + stride], docs))
                at += stride
                k += 1
                docs = docs[-1:] if len(rest) > at else []
            rest = rest[at:]
        if len(rows) >= 512:
            yield batch(rows)
            rows = []
    if rest:
        rows.append(row(rest, docs))
    if rows:
        yield batch(rows)


def _slots(batches: Iterator[pa.RecordBatch], n: int, key: int, per_shard: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.column("first").to_numpy() + b.column("k").to_numpy()
        slot = feistel(at, n, key)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "shard": pa.array(slot // per_shard)} | {c: b.column(c) for c in ("n_tokens", "doc_ids", "packed")})


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(batches: Iterator[pa.RecordBatch], to: str, seq_len: int, per_shard: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Write each shard under a name of this attempt and rename it when whole; rows come by shard and slot."""
    fs, base = _files(to)
    own = f"{TaskContext.get().taskAttemptId()}-{TaskContext.get().attemptNumber()}"
    unpack, out, now, stride = zstandard.ZstdDecompressor(), None, None, seq_len * np.dtype(dtype).itemsize

    def close() -> None:
        if out is not None:
            out.close()
            fs.move(f"{base}/.{shard_name(now)}-{own}", f"{base}/{shard_name(now)}")

    for b in batches:
        crcs = []
        for shard, data in zip(b.column("shard").to_pylist(), b.column("packed").to_pylist(), strict=True):
            if shard != now:
                close()
                now, out = shard, fs.open_output_stream(f"{base}/.{shard_name(shard)}-{own}")
            ids = unpack.decompress(data)
            out.write(ids.ljust(stride, b"\0"))
            crcs.append(zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes()))
        slot = b.column("slot").to_numpy()
        cols = {"slot": pa.array(slot), "shard": b.column("shard"), "byte_offset": pa.array(slot % per_shard * stride), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(crcs, pa.int64()), "doc_ids": b.column("doc_ids")}
        yield pa.RecordBatch.from_pydict(cols)
    close()


def _numbered(cut: DataFrame) -> tuple[DataFrame, int]:
    """The sequences with ``first``, how many those of the parts before theirs are, and how many there are in all. Sums
    over GROUP parts at a time reach the driver; those within a group are a window's."""
    counts = stored(cut.groupBy("part").agg(F.count("*").alias("n")).withColumn("grp", F.floor(F.col("part") / GROUP)), "sequence-counts")
    bases, total = [], 0
    for r in sorted(counts.groupBy("grp").agg(F.sum("n").alias("n")).collect()):
        bases.append((r.grp, total))
        total += r.n
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = counts.join(F.broadcast(cut.sparkSession.createDataFrame(bases, "grp long, base long")), "grp")
    first = based.select("part", (F.col("base") + F.coalesce(before, F.lit(0))).alias("first"))
    if counts.count() <= BROADCAST_PARTS:
        first = F.broadcast(first)
    return cut.join(first, "part"), total


def materialise(docs: DataFrame, to: str, seq_len: int = 2048, key: int = 42, per_shard: int = 8192, path: str | None = None) -> DataFrame:
    """Write the sequences of ``docs`` in training order to the folder ``to`` (a URI that all executors reach) and
    return slot, shard, byte_offset, n_tokens, ids_crc32 (of unsigned little-endian 32-bit ids), doc_ids: a row a
    sequence. Ids have 16 bits where the vocabulary allows it, else 32. The last sequence of a part of the table may be shorter than ``seq_len``; its record is filled with 0.

    Reads doc_id and text alone. A null or empty text is the end id alone. Repeated rows are written as often as they
    are there. An empty table writes index.json alone. index.json has what a reader needs.
    """
    spark, path = docs.sparkSession, path or vocabulary()
    dtype = (ID if tokenizer(path).get_vocab_size() <= 1 << 16 else WIDE).str
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = stored(in_arrow(cols, partial(_sequences, path=path, seq_len=seq_len, dtype=dtype), "part long, k long, n_tokens long, doc_ids array<long>, packed binary"), "sequences")
    numbered, n = _numbered(cut)
    fs, base = _files(to)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/index.json") as f:
        f.write(json.dumps({"n": n, "seq_len": seq_len, "per_shard": per_shard, "dtype": dtype, "key": key, "n_shards": -(-n // per_shard)}).encode())
    placed = in_arrow(numbered, partial(_slots, n=n, key=key, per_shard=per_shard), "slot long, shard long, n_tokens long, doc_ids array<long>, packed binary")
    shards = max(1, -(-n // per_shard))
    tasks = max(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-shards // TASK_SHARDS))
    dealt = placed.repartitionByRange(tasks, "shard").sortWithinPartitions("slot")
    written = in_arrow(dealt, partial(_write, to=to, seq_len=seq_len, per_shard=per_shard, dtype=dtype), "slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>")
    return stored(written, "manifest")


def read_sequences(at: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """Records from slot ``start`` on in training order, each with one seek a shard: how a training run resumes."""
    fs, base = _files(at)
    with fs.open_input_stream(f"{base}/index.json") as f:
        x = json.loads(f.read())
    stride = x["seq_len"] * np.dtype(x["dtype"]).itemsize
    slot, stop = start, x["n"] if stop is None else min(stop, x["n"])
    while slot < stop:
        shard, k = divmod(slot, x["per_shard"])
        with fs.open_input_file(f"{base}/{shard_name(shard)}") as f:
            f.seek(k * stride)
            for _ in range(min(x["per_shard"] - k, stop - slot)):
                yield np.frombuffer(f.read(stride), x["dtype"])
                slot += 1


def output_folder(spark) -> str:
    """A new folder for shards among the shared ones."""
    import uuid

    return f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
