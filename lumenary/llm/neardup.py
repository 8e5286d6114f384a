"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct word shingles. Two collections of ``bands`` half-keys, each over ``rows`` minhashes,
give the table keys: every half-key of the one with every half-key of the other. That is bands * bands tables of
2 * rows hashes each, from 2 * bands * rows minhashes. A pair with Jaccard similarity J shares a key unless all half-keys
of one collection differ: 1 - (1 - (1 - J**rows)**bands)**2, which for 3 rows and 14 bands is 9e-5 at J = 0.8 and 1e-5
at 0.82. Every candidate is confirmed on the full sets.

Documents with the same set are one class and compare once. Pairs within a key are never all made: within a part of the
table and then over all of it, each member of a key is compared with one leader, and those unlike it with a second one.
Where that leaves nodes that may be linked in different components, those outside the largest one are searched for in
blocks of their group's sets, which makes confirmed links alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_WORD, in_arrow, memory, row_key, stored
from .components import components

U = np.uint64
M1, M2, M3 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
#: Words whose hashes a worker remembers, and rows whose keys it combines before they are dealt out.
MEMO, CHUNK = 300_000, 8192
#: Bits of the filter that spares most of the second reading its work; beyond what it tells, joins decide.
FILTER_BITS = 24
#: Percent of similarity: ALIKE's distance and that of a link (20) together are at most RELATED's.
ALIKE, RELATED = 50, 30
#: Shingles and nodes of a block, on each side.
BLOCK_WORDS, BLOCK_ROWS = 1 << 19, 256
#: A key that has more than one in HOT of all rows is hot: fewer than HOT keys can be, so that they are broadcast.
HOT = 1000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * M1
    x = x ^ (x >> U(33))
    x = x * M2
    return x ^ (x >> U(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO and len(word) <= MEMO_WORD:
            self[word] = h
        return h


def word_hashes() -> WordHashes:
    """A process's remembered hashes."""
    return memory("neardup", make=WordHashes)


def shingles(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; of fewer words, one for the whole sequence."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, n)
    k = min(size, n)
    out = np.full(n - k + 1, U(k))
    for i in range(k):
        out = mixed(out * M3 + h[i : n - k + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def multipliers(n: int) -> np.ndarray:
    """Odd multipliers, one per minhash."""
    return mixed(np.arange(1, n + 1, dtype=U) * M3) | U(1)


def half_keys(s: np.ndarray, rows: int, mult: np.ndarray) -> np.ndarray:
    """The half-keys of a set, of the first collection and then of the second."""
    least = np.full(len(mult), U(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 2048):
        np.minimum(least, (mult[:, None] * s[None, i : i + 2048]).min(1), out=least)
    out = np.zeros(len(mult) // rows, U)
    for k in range(rows):
        out = mixed(out * M3 + least[k::rows])
    return out


def tensored(halves: np.ndarray, bands: int) -> np.ndarray:
    """documents x (2 * bands) half-keys to documents x (bands * bands) table keys."""
    a, b = halves[:, :bands, None], halves[:, None, bands:]
    number = np.arange(bands * bands, dtype=U).reshape(bands, bands)
    return mixed(a * M3 + mixed(b + number[None])).reshape(len(halves), bands * bands)


def _signed(batches: Iterator[pa.RecordBatch], size: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    hashes, mult = word_hashes(), multipliers(2 * bands * rows)
    for b in batches:
        n, one, two, sig = [], [], [], []
        for t in b.column("text").cast(pa.binary()):
            s = shingles(t.as_py() or b"", size, hashes)
            d = xxhash.xxh3_128_intdigest(s)
            n.append(len(s))
            one.append((d >> 65) & (1 << 63) - 1)
            two.append(d & (1 << 63) - 1)
            sig.append(half_keys(s, rows, mult).tobytes() if len(s) else None)
        out = {c: b.column(c) for c in ("rid", "doc_id", "row_key")}
        yield pa.RecordBatch.from_pydict(out | {"n_shingles": pa.array(n, pa.int64()), "s1": pa.array(one, pa.int64()), "s2": pa.array(two, pa.int64()), "sig": pa.array(sig, pa.binary())})


def _keys(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    """For each part of the table: every key once, with the least node that has it (leader null), and every further
    node of a key with that least node as its leader."""

    def part(nodes: np.ndarray, halves: np.ndarray) -> pa.RecordBatch:
        keys = tensored(halves, bands).ravel().view(np.int64)
        node = np.repeat(nodes, bands * bands)
        order = np.lexsort((node, keys))
        keys, node = keys[order], node[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        leader = node[first][np.cumsum(first) - 1]
        return pa.RecordBatch.from_pydict({"key": pa.array(keys), "node": pa.array(node), "leader": pa.array(leader, mask=first)})

    held, sigs = [], []
    for b in batches:
        for node, sig in zip(b.column("node").to_pylist(), b.column("sig").to_pylist(), strict=True):
            held.append(node)
            sigs.append(sig)
            if len(held) >= CHUNK:
                yield part(np.array(held, np.int64), np.frombuffer(b"".join(sigs), U).reshape(len(held), -1))
                held, sigs = [], []
    if held:
        yield part(np.array(held, np.int64), np.frombuffer(b"".join(sigs), U).reshape(len(held), -1))


def _sets(batches: Iterator[pa.RecordBatch], size: int, bits) -> Iterator[pa.RecordBatch]:
    """The sets of the documents whose slot is in the filter."""
    hashes, mask = word_hashes(), np.frombuffer(bits.value, np.uint8)
    for b in batches:
        at = np.array(b.column("slot").to_pylist(), np.int64)
        hit = np.flatnonzero(mask[at >> 3] >> (at & 7) & 1)
        if len(hit):
            b = b.take(pa.array(hit))
            sets = [shingles(t.as_py() or b"", size, hashes).view(np.int64) for t in b.column("text").cast(pa.binary())]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"set_id": b.column("doc_id"), "set_key": b.column("row_key"), "words": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))})


def _slot(key: str = "row_key"):
    return F.pmod(F.col(key), F.lit(1 << FILTER_BITS))


def _slot_filter(keys: DataFrame) -> bytes:
    """A bit for each slot that some row of ``keys`` has: of fixed size whatever the number of rows."""
    bit = F.expr("shiftleft(1, cast(pmod(row_key, 8) AS int))")
    got = keys.select(F.shiftright(_slot(), 3).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out.tobytes()


def _id():
    return F.coalesce(F.col("doc_id"), F.lit(-1)).alias("set_id")


def compared(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, both, size (of the union) of each candidate edge u, v, on the full sets."""
    a = sets.select(F.col("node").alias("u"), F.col("words").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("words").alias("b"))
    pair = edges.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("a", "b")))
    return pair.select("u", "v", "both", (F.size("a") + F.size("b") - F.col("both")).alias("size"))


def _beside(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``facts``, with its columns. ``facts`` has a row a key with ``n``, how many rows have it;
    the rows of hot keys stay in the tasks where they are."""
    facts = stored(facts, "facts")
    hot = F.col("n") * HOT > F.lit(facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    most = F.broadcast(facts.filter(hot).drop("n"))
    others = rows.join(most.select(key), key, "left_anti").join(facts.filter(~hot).drop("n"), key)
    return rows.join(most, key).unionByName(others)


def _linked(pdf: pa.Table, percent: int) -> pa.Table:
    """Links between the queries and the rows of one block that are in different components."""
    data, asked = pdf.filter(pc.equal(pdf["asks"], False)), pdf.filter(pc.equal(pdf["asks"], True))
    u, v = [], []
    if len(data) and len(asked):
        words = data["words"].combine_chunks()
        size = np.diff(words.offsets.to_numpy())
        flat, owner = words.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        node, root = data["node"].to_numpy(), data["root"].to_numpy()
        for q, r, w in zip(asked["node"].to_pylist(), asked["root"].to_pylist(), asked["words"].combine_chunks(), strict=True):
            own = w.values.to_numpy()
            low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            n = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(size))
            hit = (both * 100 >= (size + len(own) - both) * percent) & (root != r)
            u += [q] * int(hit.sum())
            v += node[hit].tolist()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _searched(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links u, v between nodes of one group and different components. ``nodes``: node, grp, root.

    In each group, the nodes outside the component with most nodes are queries against all. Both sides are dealt into
    blocks of bounded shingles, and each block of queries meets each block of the group in a task of its own.
    """
    of = nodes.groupBy("grp", "root").agg(F.count("*").alias("n"))
    groups = of.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("n")).filter("roots > 1").drop("roots")
    full = stored(_beside(nodes, groups, "grp").join(sets, "node").select("grp", "node", "root", "words", (F.col("root") != F.col("main")).alias("outside")), "searched")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(F.when(n, F.size("words"))) / BLOCK_WORDS, F.count(F.when(n, 1)) / BLOCK_ROWS))).cast("int")
    sized = full.groupBy("grp").agg(blocks(F.lit(True)).alias("nb"), blocks(F.col("outside")).alias("nq"), F.count("*").alias("n"))
    dealt = _beside(full, sized, "grp")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = dealt.select("grp", "node", "root", "words", F.lit(False).alias("asks"), mine("nb").alias("b"), every("nq").alias("q"))
    asks = dealt.filter("outside").select("grp", "node", "root", "words", F.lit(True).alias("asks"), every("nb").alias("b"), mine("nq").alias("q"))

    def linked(block: pa.Table) -> pa.Table:
        return _linked(block, percent)

    # Rows come dealt by group, which Spark would keep: then all blocks of a group would meet in one task.
    return data.unionByName(asks).repartition("grp", "b", "q").groupBy("grp", "b", "q").applyInArrow(linked, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = 3, bands: int = 14) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id (the least doc_id linked with, through any number of links), kept
    (doc_id = component_id) and component_root (a number that the rows of one component share and no others, which
    doc_ids that are null or repeated don't; null without shingles): one row per row of ``docs``, of which doc_id, text and source are read and other columns,
    whatever their names, are not.

    A null text, an empty one and one of white space have no shingles and no links. Repeated rows, and rows with one
    doc_id, have a result each; a null doc_id is larger than any other, and kept is true where no other is linked with
    it. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    cols = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", row_key().alias("row_key"), "text")
    schema = "rid long, doc_id long, row_key long, n_shingles long, s1 long, s2 long, sig binary"
    signed = stored(in_arrow(cols, partial(_signed, size=size, rows=rows, bands=bands), schema), "minhash")
    one = F.min_by(F.struct("doc_id", "row_key", "sig"), "rid").alias("x")
    classes = stored(signed.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_id"), one).select("s1", "s2", "node", "least_id", "x.*"), "classes")

    keys = in_arrow(classes.select("node", "sig"), partial(_keys, bands=bands), "key long, node long, leader long")
    by_key = Window.partitionBy("key")  # a key's nodes were combined within each part: at most one row a part and key meets here
    heads = keys.filter("leader IS NULL").select("key", "node").withColumns({"n": F.count("*").over(by_key), "leader": F.min("node").over(by_key)})
    spread = heads.filter("n > 1").select("key", "node", "leader")
    members = stored(spread.unionByName(keys.filter("leader IS NOT NULL")), "members")

    nodes = members.select("node").unionByName(members.select(F.col("leader").alias("node"))).distinct()
    wanted = stored(classes.join(nodes, "node", "left_semi").select("node", "doc_id", "row_key"), "wanted")
    bits = spark.sparkContext.broadcast(_slot_filter(wanted))
    found = in_arrow(docs.select("doc_id", row_key().alias("row_key"), "text").withColumn("slot", _slot()), partial(_sets, size=size, bits=bits), "set_id long, set_key long, words array<long>")
    own = wanted.select("node", _id(), F.col("row_key").alias("set_key"))
    sets = stored(found.withColumn("set_id", F.coalesce("set_id", F.lit(-1))).join(own, ["set_id", "set_key"]).groupBy("node").agg(F.first("words").alias("words")), "sets")

    # Who shares a key is put in one group: members that are at all like their key's leader (RELATED) by that link, and
    # those not well like it (ALIKE) compare with a second leader among themselves. If u is ALIKE a leader and u and v are
    # linked, v is RELATED to the leader, as Jaccard distance is a metric; so no link between nodes that meet the same
    # leader leaves a group. Members of one part of the table meet that part's leader alone: if linked u and v are ALIKE
    # the leaders of their own parts, nothing bounds the distance of those two, and this key may leave u and v in
    # different groups. A link is lost where every key that the pair shares does so and no other path joins them.
    first = stored(compared(members.filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), sets), "compared")
    alike = first.filter(F.col("both") * 100 >= F.col("size") * ALIKE).select(F.col("u").alias("node"), F.col("v").alias("leader"))
    rest = members.filter("node <> leader").select("key", "node", "leader").join(alike, ["node", "leader"], "left_anti").select("key", "node")
    rest = _led(rest)
    second = stored(compared(rest.filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), sets), "compared")
    alike = second.filter(F.col("both") * 100 >= F.col("size") * ALIKE).select(F.col("u").alias("node"), F.col("v").alias("leader"))
    last = _led(rest.filter("node <> leader").join(alike, ["node", "leader"], "left_anti").select("key", "node"))
    edges = first.unionByName(second)
    links = stored(edges.filter(F.col("both") * 100 >= F.col("size") * percent).select("u", "v"), "links")
    related = edges.filter(F.col("both") * 100 >= F.col("size") * RELATED).select("u", "v").unionByName(last.select(F.col("node").alias("u"), F.col("leader").alias("v")))
    roots, groups = stored(components(links), "roots"), components(related).select("node", F.col("root").alias("grp"))
    placed = stored(groups.join(roots, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root")), "placed")
    more = stored(_searched(placed, sets, percent), "links")
    roots = stored(components(links.unionByName(more)), "roots")

    of_class = stored(classes.select("s1", "s2", "node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    least = of_class.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    of_class = _beside(of_class, least, "root").select("s1", "s2", "component_id", F.col("root").alias("component_root"))
    has = F.col("n_shingles") > 0
    out = signed.join(of_class, ["s1", "s2"], "left").withColumns({"component_id": F.when(has, F.col("component_id")).otherwise(F.col("doc_id")), "component_root": F.when(has, F.col("component_root"))})
    return out.select("doc_id", "row_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component_root")


def _led(members: DataFrame) -> DataFrame:
    """key, node, leader: the least node of each key beside each node."""
    members = stored(members.distinct(), "members")
    return members.join(members.groupBy("key").agg(F.min("node").alias("leader")), "key")
