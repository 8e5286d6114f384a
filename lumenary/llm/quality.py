"""Quality rules: base counts of a text, and cross-document line frequency per host.

Lines are normalised (words joined by one space, A-Z lower-cased) and hashed; for each host the distinct documents with
the line are counted, where documents with the same text count once, so that copies alone don't make a line frequent.
Lines in more documents than the limit are taken out, and a document of which too little is left is rejected: `verdicts`
counts and decides, `cleaned` gives the kept documents without those lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, row_key, stored, with_values

SYMBOLS = b"#*$%&|<>"
#: Frequent lines (8 bytes each) that are sent to every task at most, and tasks that the rows of one meet beyond that.
BROADCAST_LINES, SALTS = 500_000, 32


@dataclass(frozen=True)
class Limits:
    """A line is frequent in a host when more than ``min_docs`` of its documents (counting each text once) have it, and,
    where ``percent`` is set, more than that share of them; without it the limit is the same for hosts of all sizes. A
    document is depleted when under ``left_percent`` of its words are outside frequent lines."""

    min_words: int = 50
    repeat_percent: int = 50
    min_docs: int = 20
    percent: int = 0
    left_percent: int = 30


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) >= 1 << 20:  # the product of three would leave 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(ids) + a[2:]
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    again = twice[at] == key
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= again
    return int(cover.sum())


def line_hash(words: list[bytes]) -> int:
    """Signed 64 bits of a normalised line."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words).lower())
    return h - ((h >> 63) << 64)


def describe(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each distinct normalised line by
    its 64-bit hash."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    by_line: dict[int, int] = {}
    for x in lines:
        own = x.split()
        h = line_hash(own)
        by_line[h] = by_line.get(h, 0) + len(own)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), by_line


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        rows = [describe(t.as_py() or b"") for t in texts]
        ends = np.cumsum([0, *(len(r[5]) for r in rows)], dtype=np.int32)
        lines = pa.StructArray.from_arrays([pa.array([h for r in rows for h in r[5]], pa.int64()), pa.array([w for r in rows for w in r[5].values()], pa.int64())], ["h", "w"])
        out = {n: b.column(n) for n in ("rid", "doc_id", "row_key", "host", "text_hash")}
        out |= {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(counts)}
        yield pa.RecordBatch.from_pydict(out | {"lines": pa.ListArray.from_arrays(pa.array(ends), lines)})


SCHEMA = "rid long, doc_id long, row_key long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:long>>"


def _judged(docs: DataFrame, limits: Limits) -> DataFrame:
    """What `verdicts` gives, and ``frequent``: the hashes of the frequent lines that the row has, null for none."""
    host = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    cols = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), host.alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    seen = stored(in_arrow(cols, _describe, SCHEMA), "quality")
    once = seen.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    counts = once.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > limits.min_docs)
    if limits.percent:
        n_docs = once.groupBy("host").agg(F.count("*").alias("host_docs"))
        counts = counts.join(n_docs, "host").filter(F.col("n_docs") * 100 > F.col("host_docs") * limits.percent)
    key = F.xxhash64("host", "h").alias("key")
    frequent = stored(counts.select(key), "frequent-lines")
    each = seen.select("rid", "host", F.explode("lines").alias("line")).select("rid", "host", F.col("line.h").alias("h"), F.col("line.w").alias("w")).select("rid", "h", "w", key)
    if frequent.count() <= BROADCAST_LINES:
        each = each.join(F.broadcast(frequent), "key")
    else:  # every key here is a hot one, so its rows are dealt to SALTS tasks
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        each = each.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    removed = each.groupBy("rid").agg(F.sum("w").alias("removed_words"), F.collect_list("h").alias("frequent"))  # a text's own lines
    out = seen.drop("lines").join(removed, "rid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * limits.repeat_percent)
    enough = (F.col("n_words") - F.col("removed_words")) * 100 >= F.col("n_words") * limits.left_percent
    return out.select("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_words", (~failed & enough).alias("kept"), "frequent")


def verdicts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, row_key, the base counts, base_failed, removed_words (in frequent lines) and kept: one row per row of
    ``docs``, of which doc_id, text and source are read and other columns, whatever their names, are not.

    A null text counts as empty: no words, so base_failed. A null source is a host of its own. Each repeated row has
    its own result, all the same; in the line counts their text counts once. An empty table gives no rows.
    """
    return _judged(docs, limits).drop("frequent")


def without(text: bytes, frequent: set[int]) -> bytes:
    """The text without the lines whose hashes are given; blank lines stay."""
    return b"\n".join(x for x in text.split(b"\n") if not (own := x.split()) or line_hash(own) not in frequent)


def _without(texts: pa.Array, frequent: pa.Array) -> pa.Array:
    pairs = zip(texts.cast(pa.binary()).to_pylist(), frequent.to_pylist(), strict=True)
    return pa.array([None if t is None or f is None else without(t, set(f)) for t, f in pairs], pa.binary())


def cleaned(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that `verdicts` keeps, with all their columns, and their texts without frequent lines.

    Other columns stay as they are, those that describe the text as it was among them. Repeated rows stay repeated.
    """
    column, good = f"frequent_{uuid.uuid4().hex}", _judged(docs, limits).filter("kept")
    found = with_values(docs, good.select("doc_id", "row_key", F.col("frequent").alias(column)))
    cut = F.arrow_udf(_without, "binary")(F.when(F.col(column).isNotNull(), F.col("text")), F.col(column))
    return found.withColumn("text", F.coalesce(cut.cast("string"), F.col("text"))).drop(column)


_L = Limits()
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
pos AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM pos) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 3) r(k) GROUP BY rid),
lines AS (SELECT rid, source, t, l, lower_ascii AS nl, nw FROM (
    SELECT rid, source, t, l, translate(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii,
           len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw FROM (SELECT rid, source, t, unnest(ls) AS l FROM w)) WHERE nw > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT t) AS host_docs FROM d GROUP BY source),
freq AS (SELECT f.source, nl FROM (SELECT source, nl, count(DISTINCT t) AS n FROM lines GROUP BY source, nl) f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE n > {_L.min_docs} AND n * 100 > host_docs * {_L.percent}),
gone AS (SELECT rid, sum(nw) AS removed FROM lines x WHERE EXISTS (SELECT 1 FROM freq f WHERE f.source IS NOT DISTINCT FROM x.source AND f.nl = x.nl) GROUP BY rid),
r AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN dup USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN gone USING (rid)),
v AS (SELECT *, n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.repeat_percent} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       NOT base_failed AND (n_words - removed_words) * 100 >= n_words * {_L.left_percent} AS kept FROM v
"""
