"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

The items are the indexed documents, training passages are the queries. A posting is a term's BM25 score in an item as a
share of the item's score for all its terms, so one threshold holds for all items. Items lie in blocks, and every term
has its largest share in each; blocks, and by WAND items, whose terms can't reach the threshold together are skipped.
What is retrieved is verified: of the 5-word shingles of the item's question and of its answer (its last sentence), a
share must stand in the passage.
"""

from __future__ import annotations

import math
import uuid
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORD, in_arrow, memory, row_key, stored

K1, B = 1.2, 0.75
#: Blocks of an index at most, bytes of item texts in one, and in those that are searched in one scan.
BLOCKS, INDEX_BYTES, SCAN_BYTES = 64, 2 << 20, 8 << 20
MEMO = 300_000
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Rules:
    """``share``: of an item's score that a passage must reach to be retrieved. ``percent``: of the shingles of question
    and of answer that the passage must have. ``size``: words of a shingle."""

    share: float = 0.6
    percent: int = 80
    size: int = 5


def plain(word: bytes) -> bytes:
    """A word without ASCII marks at its ends, lower-cased in A-Z."""
    return word.strip(EDGES)


def words_of(text: bytes) -> list[bytes]:
    return [p for p in map(plain, text.lower().split()) if p]


def shingled(words: list[bytes], size: int) -> set:
    """Distinct shingles; fewer words make one."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def parts_of(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of question and answer: the answer is the last line or sentence where that leaves a question of at least
    as many words; other items are all question."""
    whole = words_of(text)
    body = text.rstrip()
    cut = max(body.rfind(b"\n"), body.rfind(b". ", 0, len(body) - 1), body.rfind(b"? "), body.rfind(b"! "))
    answer = words_of(body[cut + 1 :]) if cut > 0 else []
    return (whole[: -len(answer)], answer) if answer and 2 * len(answer) <= len(whole) else (whole, [])


class Index:
    """Postings of some items. Items are numbered so that those with the same frequent words are neighbours, and ranges
    of numbers are the blocks; ``tops`` has each term's largest share in each block. ``term`` numbers the words of all
    indexes that are searched together; an index numbers its own ones again (``local``), 0 being all others."""

    def __init__(self, items: list[tuple[int, bytes]], rules: Rules, term: dict[bytes, int] | None = None):
        self.rules, self.term = rules, {} if term is None else term
        bags = [(i, t, w) for i, t in items if (w := words_of(t))]
        df = Counter(x for _, _, w in bags for x in set(w))
        frequent = [x for x, _ in sorted(df.items(), key=lambda p: (-p[1], p[0]))[:64]]
        bags.sort(key=lambda b: ([x not in b[2] for x in frequent], b[0]))
        self.ids, self.texts = [i for i, _, _ in bags], [t for _, t, _ in bags]
        self.span = max((len(w) for _, _, w in bags), default=0)
        n, mean = len(bags), sum(len(w) for _, _, w in bags) / max(1, len(bags))
        self.block = max(1, -(-n // BLOCKS))
        own: dict[bytes, int] = {}
        self.lists = [(array("i"), array("d"))]
        self.tops = np.zeros((1 + len(df), -(-n // self.block) if n else 1))
        for k, (_, _, w) in enumerate(bags):
            score = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)) for x, tf in Counter(w).items()}
            total = sum(score.values())
            for x, s in score.items():
                t = own.setdefault(x, len(self.lists))
                if t == len(self.lists):
                    self.lists.append((array("i"), array("d")))
                self.lists[t][0].append(k)
                self.lists[t][1].append(s / total)
                self.tops[t, k // self.block] = max(self.tops[t, k // self.block], s / total)
        self.most = self.tops.max(1)
        self.numbers = [(self.term.setdefault(x, len(self.term) + 1), t) for x, t in own.items()]
        self.fit(len(self.term) + 1)

    def fit(self, terms: int) -> None:
        """Make ``local`` as long as there are terms in all indexes."""
        self.local = np.zeros(terms, np.int32)
        for t, own in self.numbers:
            self.local[t] = own

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items (by number) that reach the share with the distinct ``terms``, in the order of their numbers: WAND
        within each block whose largest shares together reach it."""
        need, out = self.rules.share - 1e-9, []
        tops = self.tops[terms]
        for block in np.flatnonzero(tops.sum(0) >= need).tolist():
            own = tops[:, block]
            out += self._wand([(t, s) for t, s in zip(terms.tolist(), own.tolist(), strict=True) if s], block * self.block, (block + 1) * self.block, need)
        return out

    def _wand(self, terms: list[tuple[int, float]], low: int, high: int, need: float) -> list[tuple[int, float]]:
        """The items low .. high - 1 that reach ``need``; terms come with their largest share there."""
        out, cursors = [], []
        for t, top in terms:
            at = bisect_left(self.lists[t][0], low)
            cursors.append([self.lists[t][0][at], at, top, *self.lists[t]])
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= need:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            to = pivot
            if cursors[0][0] == pivot:
                got = sum(c[4][c[1]] for c in cursors if c[0] == pivot)
                if got >= need:
                    out.append((pivot, got))
                to = pivot + 1
            rest = []
            for c in cursors:
                if c[0] < to:
                    c[1] = bisect_left(c[3], to, c[1])
                    c[0] = c[3][c[1]] if c[1] < len(c[3]) else high
                if c[0] < high:
                    rest.append(c)
            cursors = rest
        return out

    def verified(self, item: int, grams: set) -> float:
        """The least share of the shingles of a part of the item that is among ``grams``, in percent."""
        parts = (shingled(p, self.rules.size) for p in parts_of(self.texts[item]) if p)
        return min(100 * len(p & grams) / len(p) for p in parts)


class Terms(dict):
    """The term of a word as written, remembered up to a bound: 0 for words that no item has, -1 for marks alone."""

    def __init__(self, term: dict[bytes, int]):
        super().__init__()
        self.term = term

    def __missing__(self, word: bytes) -> int:
        own = plain(word)
        t = self.term.get(own, 0) if own else -1
        if len(self) < MEMO and len(word) <= MEMO_WORD:
            self[word] = t
        return t


def search(text: bytes, index: Index, terms: Terms) -> dict[int, tuple[float, float]]:
    """item number: (largest share, largest verified percentage) over the passages of a text, for one index."""
    return next(iter(search_all(text, [index], terms)))


def search_all(text: bytes, indexes: list[Index], terms: Terms) -> Iterator[dict[int, tuple[float, float]]]:
    """For each index, item number: (largest share, largest verified percentage) over the passages of a text.

    Passages are twice as long as the index's longest item and overlap by half, so every stretch as long as an item lies
    whole in one. A passage whose words can't reach the share together is not scored, which is exact.
    """
    words = text.lower().split()
    t = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
    if len(t) and t.min() < 0:
        words, t = [w for w, k in zip(words, t.tolist(), strict=True) if k >= 0], t[t >= 0]
    for index in indexes:
        out: dict[int, tuple[float, float]] = {}
        if words and index.ids:
            step, size = max(8, index.span), index.rules.size
            own = index.local[t]
            bounds = np.concatenate(([0.0], np.cumsum(index.most[own])))
            starts = np.arange(0, max(1, len(words) - step), step)
            total = bounds[np.minimum(starts + 2 * step, len(words))] - bounds[starts]
            for at in starts[total >= index.rules.share - 1e-6].tolist():
                here = own[at : at + 2 * step]
                hits = index.retrieve(np.unique(here[here > 0]))
                if hits:
                    passage = [*map(plain, words[at : at + 2 * step])]
                    grams = {tuple(passage[i : i + k]) for k in range(1, size + 1) for i in range(len(passage) - k + 1)}
                    for item, share in hits:
                        a, b = out.get(item, (0.0, 0.0))
                        out[item] = max(a, share), max(b, index.verified(item, grams))
        yield out


def indexed(items: list[tuple[int, bytes]], rules: Rules) -> tuple[list[Index], Terms]:
    """The items in indexes of at most INDEX_BYTES each (or one item), by length: an index's passages suit its longest
    item, so those of different lengths (by a factor of four) have indexes of their own."""
    bands: dict[int, list[tuple[int, bytes]]] = {}
    for i, t in items:
        bands.setdefault((max(len(t.split()), 32).bit_length() + 1) // 2, []).append((i, t))
    term: dict[bytes, int] = {}
    out = []
    for _, band in sorted(bands.items()):
        part, size = [], 0
        for item in band:
            if part and size + len(item[1]) > INDEX_BYTES:
                out.append(Index(part, rules, term))
                part, size = [], 0
            part.append(item)
            size += len(item[1])
        out.append(Index(part, rules, term))
    for index in out:
        index.fit(len(term) + 1)
    return out, Terms(term)


def _found(texts: pa.Array, name: str, data, rules: Rules) -> Iterator[list[tuple[int, float, float]]]:
    """item_id, share and percentage of what each text contains."""
    indexes, terms = memory("decontaminate", name, make=lambda: indexed(data.value, rules))
    for t in texts.cast(pa.binary()):
        yield [
            (index.ids[k], share, percent)
            for index, found in zip(indexes, search_all(t.as_py() or b"", indexes, terms), strict=True)
            for k, (share, percent) in sorted(found.items())
            if percent >= rules.percent
        ]


TYPES = (("doc_id", pa.int64()), ("row_key", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("overlap_percent", pa.float64()))


def _matches(batches: Iterator[pa.RecordBatch], name: str, data, rules: Rules) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = _found(b.column("text"), name, data, rules)
        rows = [(d, k, *x) for d, k, hits in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), found, strict=True) for x in hits]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(TYPES)})


def _without(batches: Iterator[pa.RecordBatch], name: str, data, rules: Rules) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([not hits for hits in _found(b.column("text"), name, data, rules)], pa.bool_()))


def _scans(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items by SCAN_BYTES of text: what the driver holds, and a task, at once."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SCAN_BYTES) or 1
    for k in range(n):
        yield sorted((r.item_id, bytes(r.text)) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect())


def leaks(docs: DataFrame, items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, row_key, item_id, score (share of the item's BM25 score, 0 to 1), overlap_percent: a row for each row of
    ``docs`` and each item that it contains. ``items`` has item_id and text; further columns of either aren't read.
    Ids are read as longs: one that isn't a number raises under ANSI rules.

    Null and empty texts, and texts of marks alone, match nothing, on either side. Repeated documents match each by
    themselves; items of one text match each. Empty tables give no rows. Rows are scanned once for each ``SCAN_BYTES``
    of item texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    out = None
    for rows in _scans(items):
        data = docs.sparkSession.sparkContext.broadcast(rows)
        part = in_arrow(docs, partial(_matches, name=uuid.uuid4().hex, data=data, rules=rules), "doc_id long, row_key long, item_id long, score double, overlap_percent double")
        out = part if out is None else out.unionByName(part)
    return out


def clean_rows(docs: DataFrame, items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns, in the scans of `leaks`; rows meet no shuffle."""
    out = None
    for rows in _scans(items):
        data = docs.sparkSession.sparkContext.broadcast(rows)
        out = in_arrow(docs if out is None else stored(out, "clean"), partial(_without, name=uuid.uuid4().hex, data=data, rules=rules), docs.schema)
    return out
