"""Best-fit packing of documents into sequences by hierarchical residual packing.

Each part of the table packs its own pieces best-fit, longest first, and hands out the sequences that are nearly full.
The others become single items of a next round over fewer parts, which merges what fits together, and so on up a tree
until the rest is one part or no longer shrinks. A row is a sequence with its pieces, at most ``seq_len`` of them, so
nothing grows with the table, and no round puts more than ``PART`` items in one task, or ``MERGED`` sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stored
from .tokens import IdBytes, ids_of, vocabulary

END = (0).to_bytes(4, "little")
PART = 65_536
MERGED = 32_768
FULL_PERCENT = 99

ITEM = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long,ids:binary>"
SCHEMA = f"sequence_id long, fill int, items array<{ITEM}>"
ITEM_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins as lists of item numbers: longest first, each into the bin that it leaves fullest.

    ``open_`` has a bit for each room that some open bin has left, so the best bin is the lowest bit from the size up.
    """
    bins: list[list[int]] = []
    left: list[list[int]] = [[] for _ in range(room + 1)]
    open_ = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = left[r].pop()
            if not left[r]:
                open_ &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = room, len(bins)
            bins.append([i])
        r -= size
        if r:
            left[r].append(b)
            open_ |= 1 << r
    return bins


def pieces(text: str | None, of: IdBytes, seq_len: int, keep_ids: bool) -> list[dict[str, Any]]:
    """The pieces of a document: its ids and the end id, cut only where longer than a sequence."""
    ids = (of.text(text) if text else b"") + END
    step = seq_len * 4
    return [{"piece": k, "start": at // 4, "length": len(cut) // 4, "ids_crc32": zlib.crc32(cut), "ids": cut if keep_ids else None} for k, at in enumerate(range(0, len(ids), step)) for cut in (ids[at : at + step],)]


class _Out:
    """Numbers sequences and makes batches of them."""

    def __init__(self, round_: int):
        self.next = (round_ << 56) + (TaskContext.get().partitionId() << 32)

    def batch(self, bins: list[list[dict]]) -> pa.RecordBatch:
        rows, fills = [], []
        for items in bins:
            at = 0
            row = []
            for x in items:
                row.append(x | {"offset": at})
                at += x["length"]
            rows.append(row)
            fills.append(at)
        ids = range(self.next, self.next + len(rows))
        self.next += len(rows)
        return pa.RecordBatch.from_pydict({"sequence_id": pa.array(ids, pa.int64()), "fill": pa.array(fills, pa.int32()), "items": pa.array(rows, pa.list_(ITEM_ARROW))})


def _first(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    of, out, held = ids_of(path), _Out(0), []
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            held += [x | {"doc_id": doc_id} for x in pieces(text.as_py(), of, seq_len, keep_ids)]
            if len(held) >= PART:
                yield out.batch([[held[i] for i in b] for b in best_fit([x["length"] for x in held], seq_len)])
                held = []
    if held:
        yield out.batch([[held[i] for i in b] for b in best_fit([x["length"] for x in held], seq_len)])


def _merge(batches: Iterator[pa.RecordBatch], seq_len: int, round_: int) -> Iterator[pa.RecordBatch]:
    """Sequences as items of a best-fit round; what comes together keeps its pieces."""
    out, held = _Out(round_), []

    def packed() -> pa.RecordBatch:
        bins = best_fit([sum(x["length"] for x in items) for items in held], seq_len)
        return out.batch([[x for i in b for x in held[i]] for b in bins])

    for b in batches:
        for items in b.column("items").to_pylist():
            held.append(items)
            if len(held) >= MERGED:
                yield packed()
                held = []
    if held:
        yield packed()


def pack(docs: DataFrame, seq_len: int = 2048, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """sequence_id, fill, items: a row a sequence of at most ``seq_len`` tokens, with its pieces (doc_id, piece, start,
    length, ids_crc32, offset, and ids where asked for) in their order; pieces lie without gaps from offset 0.

    Reads doc_id and text alone. A null or empty text is one piece of the end id. Every row of ``docs`` is packed,
    repeated rows and rows with a null doc_id too. An empty table gives no rows. ``path`` is a vocabulary file whose
    tokens span no blank.
    """
    path = path or vocabulary()
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = stored(in_arrow(cols, partial(_first, path=path, seq_len=seq_len, keep_ids=keep_ids), SCHEMA), "packed")
    full = F.col("fill") * 100 >= seq_len * FULL_PERCENT
    done, k = None, 0
    while True:
        ended, rest, k = at.filter(full), at.filter(~full), k + 1
        done = ended if done is None else done.unionByName(ended)
        n = rest.count()
        parts = -(-n // MERGED) or 1
        at = stored(in_arrow(rest.repartition(parts), partial(_merge, seq_len=seq_len, round_=k), SCHEMA), "packed")
        if parts == 1 or at.count() * 1000 > n * 999:  # one part, or sequences that don't fit together
            return done.unionByName(at)


def packed_pieces(docs: DataFrame, seq_len: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row a piece; see ``pack``."""
    return pack(docs, seq_len, path).select("sequence_id", F.inline("items")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
