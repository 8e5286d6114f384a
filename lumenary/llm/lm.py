"""Language-model scores of whole texts: a word-frequency base and a causal self-attention model over subword ids.

Words are counted over all training texts. Their counts give the base score, and the frequencies of the ids of a public
byte-level vocabulary: the network has a slot for each of the most frequent ones, and an id without a slot is scored as
P(no slot) times its share among such ids. Ids spell a text's words as they are, so the score is a probability of the
sequence of words.

The network learns from every id of every training text and from its end, once each, whatever the size of the table.
Copies of it learn from parts of them, and their mean is what all go on from in the next round.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import END, RARE, Adam, Scorer, Shape, gradients, initial, pack, unpack
from .common import in_arrow, memory, row_key, stored
from .tokens import ranked, vocabulary

#: Distinct words that a counting task holds when it passes them on (up to twice as many, and those of a batch), words that a scoring worker remembers, and words scored at once.
HELD, MEMO, LOT_WORDS = 400_000, 300_000, 200_000
#: Ids of the words that a scoring worker remembers.
MEMO_IDS = 4_000_000
#: Words whose counts go to every worker; those of others are joined.
FREQUENT = 250_000
#: Copies of the network that learn side by side at most, windows for each and round at least, and means that reach the
#: driver at most.
COPIES, COPY_WINDOWS, MEANS = 1024, 64_000, 32
#: Windows that a task holds before it passes them on, and windows in a row of those that are stored.
LOT_WINDOWS, ROW_WINDOWS = 50_000, 256
#: Bytes that are allocated and freed before steps of many arrays: from then on, malloc keeps that much between them and
#: doesn't ask the system for zeroed pages at every step.
HEAP = 24 << 20
PAD = 0xFFFF


@dataclass(frozen=True)
class Settings:
    """``rounds``: of learning, each from other windows, with averages in between. All windows are learnt from once; only
    where ``least_tokens`` is set and they have fewer ids, more often, ``passes`` times at most."""

    shape: Shape = field(default_factory=Shape)
    least_tokens: int = 0
    rounds: int = 4
    passes: int = 6
    batch: int = 128
    rate: float = 0.03
    seed: int = 1


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 by 5; a null id's row isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def listed(words: pa.Array) -> list[bytes]:
    """What an array of words without blanks has, in a list."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.view(pa.binary())), b" ")[0].as_py().split(b" ")


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the numbers of all their words among these, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
    coded = lists.flatten().dictionary_encode()
    distinct, codes = listed(coded.dictionary), coded.indices.to_numpy()
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    if b"" in distinct:  # before, between and behind white space
        real = codes != distinct.index(b"")
        n = np.diff(np.concatenate(([0], np.cumsum(real)))[np.concatenate(([0], np.cumsum(n)))])
        codes = codes[real]
    return distinct, codes, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts in a part of the table, some words more than once."""
    held: list[pa.Table] = []
    for b in batches:
        words, codes, _ = words_of(b.column("text"))
        counts = np.bincount(codes, minlength=len(words))
        held.append(pa.table({"word": pa.array(words, pa.binary()), "n": pa.array(counts, pa.int64())}).filter(pc.field("n") > 0))
        if sum(map(len, held)) > 2 * HELD:
            held = [_summed(held)]
            if len(held[0]) > HELD:
                yield from held.pop().to_batches()
    if held:
        yield from _summed(held).to_batches()


def _summed(parts: list[pa.Table]) -> pa.Table:
    """One row a word."""
    out = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": out["word"], "n": out["n_sum"]})


def spelt(words: list[bytes], of) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word with a blank before it, one after another, and how many each has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.array(of.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.int64)
    begins = np.flatnonzero(starts_of(of)[ids])
    if len(begins) != len(words):  # some word has white space of another kind at its ends
        each = [of.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([i for e in each for i in e], np.int64), np.array([*map(len, each)], np.int64)
    return ids, np.diff(np.append(begins, len(ids)))


@lru_cache(maxsize=2)
def starts_of(of) -> np.ndarray:
    """Which ids begin with a blank."""
    return np.array([of.decode_single_token_bytes(i)[:1] == b" " for i in range(of.n_vocab)])


def _id_counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    of = ranked(path)
    n = np.zeros(of.n_vocab)
    for b in batches:
        ids, lens = spelt(b.column("word").to_pylist(), of)
        n += np.bincount(ids, weights=np.repeat(b.column("n").to_numpy(), lens), minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"id": pa.array(at), "n": pa.array(n[at].astype(np.int64))})


@dataclass
class Slots:
    """The slot of each id, and the log of an id's share among those without a slot (0 for those with one)."""

    slot: np.ndarray
    rare: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, texts: int, shape: Shape) -> Slots:
        top = np.argsort(-counts, kind="stable")[: shape.slots - 2]
        slot = np.full(len(counts), RARE, np.int32)
        slot[top] = np.arange(2, 2 + len(top))
        left = counts + 0.5
        left[top] = 0
        rare = np.log(np.where(left > 0, left, 1) / max(left.sum(), 0.5))
        rare[top] = 0
        by_slot = np.bincount(slot, weights=counts, minlength=shape.slots)
        by_slot[END] = texts
        return cls(slot, rare, by_slot)


def windows_of(ids: np.ndarray, shape: Shape) -> np.ndarray:
    """Rows of a window's ids and the one after them, in which each id of a text and the end after it are to be told
    once; before the text and behind its end is PAD."""
    return _windows_of([ids], shape)[0]


def _windows_of(texts: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The rows of some texts, one text's after another's, and how many each has."""
    lengths = np.array([*map(len, texts)], np.int64)
    n = -(-(shape.stride + lengths + 1) // shape.window)
    size = n * shape.window + 1
    begin = np.cumsum(size) - size
    flat = np.full(int(size.sum()), PAD, "<u2")
    for ids, at in zip(texts, (begin + shape.stride + 1).tolist(), strict=True):
        flat[at : at + len(ids)] = ids
    flat[begin + shape.stride + 1 + lengths] = END
    return np.lib.stride_tricks.sliding_window_view(flat, shape.window + 1)[np.repeat(begin, n) + shape.window * _places(n)], n


def _places(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of some counts, one after another."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _rounds(texts: list[bytes], n: np.ndarray, s: Settings) -> np.ndarray:
    """The round of each window of some texts, dealt by a hash of its text and its place there."""
    own = np.array([zlib.crc32(t, s.seed) for t in texts], np.uint64)
    h = np.repeat(own, n) * np.uint64(0x9E3779B97F4A7C15) + (_places(n) + 1).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(32)).astype(np.int64) % s.rounds


def _dealt(batches: Iterator[pa.RecordBatch], path: str, slots, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lots of windows of texts, and the round that each is learnt in; the batches have texts, or slots as read before."""
    slot = slots.value.slot
    for b in batches:
        read = "slots" in b.schema.names
        texts = [t.as_py() or b"" for t in b.column("slots" if read else "text").cast(pa.binary())]
        at = 0
        while at < len(texts):
            lot, n = [], 0
            while at + len(lot) < len(texts) and n < LOT_WINDOWS:
                text = texts[at + len(lot)]
                lot.append(np.frombuffer(text, "<u2") if read else slot[spelt(text.lower().split(), ranked(path))[0]])
                n += (s.shape.stride + len(lot[-1])) // s.shape.window + 1
            rows, each = _windows_of(lot, s.shape)
            yield rows, _rounds(texts[at : at + len(lot)], each, s)
            at += len(lot)


def _windows(batches: Iterator[pa.RecordBatch], path: str, slots, s: Settings) -> Iterator[pa.RecordBatch]:
    """The windows of each text, and the round that each is learnt in."""
    size = 2 * (s.shape.window + 1)
    for rows, rounds in _dealt(batches, path, slots, s):
        window = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows.tobytes())])
        yield pa.RecordBatch.from_pydict({"round": pa.array(rounds, pa.int32()), "window": window.cast(pa.binary())})


def _window_rows(batches: Iterator[pa.RecordBatch], path: str, slots, s: Settings) -> Iterator[pa.RecordBatch]:
    """The same windows, up to ROW_WINDOWS of a round in a row: rows are then few to store, to read and to deal."""
    np.empty(HEAP, np.uint8)
    for data, round_ in _dealt(batches, path, slots, s):
        rows = [(r, len(x), x.tobytes()) for r in range(s.rounds) for own in (data[round_ == r],) for i in range(0, len(own), ROW_WINDOWS) for x in (own[i : i + ROW_WINDOWS],)]
        rounds, ns, parts = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict({"round": pa.array(rounds, pa.int32()), "n": pa.array(ns, pa.int64()), "windows": pa.array(parts, pa.binary())})


def _learnt(batches: Iterator[pa.RecordBatch], start, s: Settings, round_: int, expected: float, passes: int) -> Iterator[pa.RecordBatch]:
    """The parameters after a task's windows, and how many it had; no windows, no row. The rate rises over the first
    steps and falls to nearly nothing over the last two fifths of all rounds, of which a task expects to see so many."""
    like = initial(np.ones(s.shape.slots), s.shape)
    p = unpack(start.value, like)
    adam, n, done = Adam(p, s.rate), 0, 0
    rng = np.random.default_rng(s.seed)
    np.empty(HEAP, np.uint8)
    for b in batches:
        rows = np.frombuffer(b"".join(b.column("windows").to_pylist()), "<u2").reshape(-1, s.shape.window + 1).astype(np.int32)
        xs, ys = np.where(rows[:, :-1] == PAD, END, rows[:, :-1]), np.where(rows[:, 1:] == PAD, -1, rows[:, 1:])
        n += len(rows)
        for _ in range(passes):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), s.batch):
                lot = order[i : i + s.batch]
                at = (round_ + min(1.0, done / (expected * passes))) / s.rounds
                adam.rate = s.rate * min(1.0, (adam.step + 1) / 40) * min(1.0, (1 - at) / 0.4 + 0.02)
                done += len(lot)
                adam.update(p, gradients(p, xs[lot], ys[lot], s.shape)[1])
    if n:
        group = TaskContext.get().partitionId() % MEANS
        yield pa.RecordBatch.from_pydict({"grp": pa.array([group], pa.int32()), "n": pa.array([n], pa.int64()), "p": pa.array([pack(p)], pa.binary())})


def _mean(rows: pa.Table) -> pa.Table:
    """The mean of some parameters, weighted by windows."""
    n = rows["n"].to_numpy()
    p = sum(w * np.frombuffer(x.as_py(), "<f4").astype(float) for w, x in zip(n / n.sum(), rows["p"], strict=True))
    return pa.table({"n": pa.array([n.sum()], pa.int64()), "p": pa.array([p.astype("<f4").tobytes()], pa.binary())})


def learnt(windows: DataFrame, counts: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """The network's parameters after all rounds over the table ``windows`` of ``_window_rows``; its size is that of the parameters."""
    spark = windows.sparkSession
    like = initial(counts, s.shape, s.seed)
    p, n = pack(like), windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = min(COPIES, max(1, round(n / s.rounds / COPY_WINDOWS)))
    passes = max(1, min(s.passes, s.least_tokens // max(1, n * s.shape.window)))
    for r in range(s.rounds if n else 0):
        start = spark.sparkContext.broadcast(p)
        part = windows.filter(F.col("round") == r).select("windows").repartition(copies)
        each = in_arrow(part, partial(_learnt, start=start, s=s, round_=r, expected=n / s.rounds / copies, passes=passes), "grp int, n long, p binary")
        got = each.groupBy("grp").applyInArrow(_mean, "n long, p binary").toArrow()
        if len(got):
            p = _mean(got)["p"][0].as_py()
    return unpack(p, like)


@dataclass
class Model:
    """What scoring needs: parameters (none for reading alone), slots, the words with the largest counts, and the base's
    totals."""

    params: dict[str, np.ndarray] | None
    shape: Shape
    slots: Slots
    path: str
    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    texts: int


class Worker:
    """A process's view of a model: its words by number, with their ids, base counts and shares of rare ids."""

    def __init__(self, m: Model):
        self.m, self.of, self.scorer = m, ranked(m.path), Scorer(m.params, m.shape) if m.params else None
        self.base = {w: c for w, c in zip(m.words, m.counts.tolist(), strict=True)}
        self.number: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.rare, self.count = np.zeros(1 << 14), np.zeros(1 << 14)

    def learn(self, words: list[bytes]) -> None:
        ids, lens = spelt(words, self.of)
        at, n = len(self.number), len(words)
        grown = lambda x, size: x if len(x) >= size else np.resize(x, max(size, 2 * len(x)))
        self.ids = grown(self.ids, self.used + len(ids))
        for name in ("first", "size", "rare", "count"):
            setattr(self, name, grown(getattr(self, name), at + n))
        self.ids[self.used : self.used + len(ids)] = self.m.slots.slot[ids]
        begin = np.cumsum(lens) - lens
        self.first[at : at + n], self.size[at : at + n] = self.used + begin, lens
        self.rare[at : at + n] = np.add.reduceat(self.m.slots.rare[ids], begin)
        self.count[at : at + n] = [self.base.get(w, -1) for w in words]
        self.used += len(ids)
        self.number.update(zip(words, range(at, at + n), strict=True))

    def forget(self) -> None:
        """Keep the first MEMO words, or fewer long ones: MEMO_IDS ids at most."""
        while (n := len(self.number)) > MEMO or self.used > MEMO_IDS:
            self.number.popitem()
            self.used = int(self.first[n - 1])

    def read(self, texts: list[bytes]) -> dict[str, pa.Array | np.ndarray]:
        """n_tokens, known and base of each text, the last two without the words in ``others``; the slots of all texts one
        after another, how many each has, and its log share of rare ids."""
        m = self.m
        words, codes, n = words_of(pa.array(texts, pa.binary()))
        at = np.array([*map(self.number.get, words, repeat(-1))], np.int64)
        if len(missing := np.flatnonzero(at < 0)):
            new = [(k, w) for k in missing.tolist() if (w := words[k])]  # no word is empty
            at[missing] = 0
            at[[k for k, _ in new]] = np.arange(len(self.number), len(self.number) + len(new))
            self.learn([w for _, w in new])
        # From here on by distinct word, and by word where sums are.
        sizes, ends = self.size[at], np.concatenate(([0], np.cumsum(n)))
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[codes])))[ends])
        count = self.count[at]
        here, whole = count >= 0, log(m.tokens + 0.5 * (m.distinct + 1))
        base = total(np.where(here, np.log(np.maximum(count, 0) + 0.5) - whole, 0.0)) + log(m.texts + 0.5) - whole
        spelt_ = self.ids[np.repeat(self.first[at], sizes) + _places(sizes)].astype("<u2")
        bounds = np.concatenate(([0], 2 * np.cumsum(sizes))).astype(np.int32)
        slots = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(spelt_)]).take(pa.array(codes))
        slots = np.frombuffer(slots.buffers()[2] or b"", "<u2", int(sizes[codes].sum()))
        left = ~here[codes]
        others = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left)))[ends], pa.int32()), pa.array(words, pa.binary()).take(pa.array(codes[left])))
        if len(self.number) > MEMO or self.used > MEMO_IDS:
            self.forget()
        known = total(here & (count > 0)) + (m.texts > 0)
        return {"n_tokens": n + 1, "known": known, "base": base / log(10), "others": others, "slots": slots, "sizes": total(sizes.astype(np.int64)), "rare": total(self.rare[at])}

    def scores(self, texts: list[bytes]) -> dict[str, pa.Array | np.ndarray]:
        """n_tokens, known, base, others and score of each text."""
        x = self.read(texts)
        return x | {"score": (self.scorer.texts(x["slots"], x["sizes"]) + x["rare"]) / log(10)}


def _lots(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``size`` bytes about, or a longer text alone."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) < size):
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


def _distinct(lists: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """The distinct words of each list, and how often each is in it."""
    words = lists.flatten().dictionary_encode()
    of, most = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), max(1, len(words.dictionary))
    pairs, times = np.unique(of * most + words.indices.to_numpy(), return_counts=True)
    ends = pa.array(np.searchsorted(pairs, np.arange(len(lists) + 1) * most), pa.int32())
    return pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(pairs % most))), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def _read(batches: Iterator[pa.RecordBatch], name: str, data) -> Iterator[pa.RecordBatch]:
    """What ``Worker.read`` has for each text, in columns."""
    worker = memory("lm", name, make=lambda: Worker(data.value))
    np.empty(HEAP, np.uint8)
    for b in batches:
        texts = [t.as_py() or b"" for t in b.column("text").cast(pa.binary())]
        for at, to in _lots(texts, LOT_WORDS * 6):
            x = worker.read(texts[at:to])
            cols = {c: b.column(c).slice(at, to - at) for c in ("rid", "doc_id", "row_key", "held_out")}
            cols |= {c: pa.array(x[c], pa.int64() if c in ("n_tokens", "known") else pa.float64()) for c in ("n_tokens", "known", "base", "rare")}
            ends = np.concatenate(([0], np.cumsum(2 * x["sizes"]))).astype(np.int32)
            slots = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x["slots"])])
            others, times = _distinct(x["others"])
            yield pa.RecordBatch.from_pydict(cols | {"others": others, "times": times, "slots": slots})


def _scored(batches: Iterator[pa.RecordBatch], name: str, data) -> Iterator[pa.RecordBatch]:
    """The score of each row of ``_read``, in place of its slots and rare ids' share."""
    scorer = memory("lm", name, make=lambda: Scorer(*data.value))
    np.empty(HEAP, np.uint8)
    for b in batches:
        texts, rare, scores = b.column("slots").to_pylist(), b.column("rare").to_numpy(), np.zeros(len(b))
        for at, to in _lots(texts, LOT_WORDS * 6):
            once: dict[bytes, int] = {}  # repeated texts are scored once
            which = np.array([once.setdefault(t, len(once)) for t in texts[at:to]], np.int64)
            slots = np.frombuffer(b"".join(once), "<u2").astype(np.int32)
            scores[at:to] = scorer.texts(slots, np.array([len(t) // 2 for t in once], np.int64))[which]
        cols = {c: b.column(c) for c in ("rid", "doc_id", "row_key", "held_out", "n_tokens", "known", "base")}
        yield pa.RecordBatch.from_pydict(cols | {"score": pa.array((scores + rare) / log(10))})


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words with the largest counts, ``most`` of them at most: all above a count that a histogram gives."""
    level = F.floor(F.log2("n") * 16).cast("int")
    n = 0
    least = None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # 1024 rows at most
        n += r.words
        if n > most:
            break
        least = r.level
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def scored(docs: DataFrame, s: Settings = Settings(), path: str | None = None) -> DataFrame:
    """doc_id, row_key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``, of
    which doc_id, text and source are read (source for row_key alone) and other columns aren't.

    A null text counts as empty: its one token is the end. Repeated rows have equal scores, as the network's
    single precision is given to 5 decimals, and each counts in the counts that are learnt from. A null doc_id's row is learnt from. Where no row is learnt from, the base gives every
    token the same probability, and so nearly does the network. An empty table gives no rows. ``path`` is a byte-level
    vocabulary as ranks.
    """
    spark, path = docs.sparkSession, path or vocabulary("byte_bpe_multi_50k.tiktoken")
    cols = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), held_out().alias("held_out"), "text")
    learning = cols.filter(~F.col("held_out")).select("text")
    counts = stored(in_arrow(learning, _counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    texts = learning.count()
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ids = np.zeros(ranked(path).n_vocab)
    for r in in_arrow(counts, partial(_id_counts, path=path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id of the vocabulary
        ids[r.id] = r.n
    slots = Slots.of(ids, texts, s.shape)
    sent = spark.sparkContext.broadcast(slots)
    frequent = most_frequent(counts, FREQUENT).toArrow()
    model = Model(None, s.shape, slots, path, frequent["word"].to_pylist(), frequent["n"].to_numpy(), n + texts, distinct + (texts > 0), texts)
    keys = "rid long, doc_id long, row_key long, held_out boolean, n_tokens long, known long, base double"
    read = stored(in_arrow(cols, partial(_read, name=uuid.uuid4().hex, data=spark.sparkContext.broadcast(model)), f"{keys}, rare double, others array<binary>, times array<long>, slots binary"), "read")
    learning = read.filter(~F.col("held_out")).select("slots")
    windows = stored(in_arrow(learning, partial(_window_rows, path=path, slots=sent, s=s), "round int, n long, windows binary"), "windows")
    params = spark.sparkContext.broadcast((learnt(windows, slots.counts, s), s.shape))
    seen = stored(in_arrow(read.drop("others", "times"), partial(_scored, name=uuid.uuid4().hex, data=params), f"{keys}, score double"), "scored")
    each = read.select("rid", F.explode(F.arrays_zip(F.col("others").alias("word"), "times")).alias("o")).select("rid", "o.word", "o.times")
    c = F.coalesce(F.col("n"), F.lit(0))
    whole = model.tokens + 0.5 * (model.distinct + 1)
    more = each.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(float(whole)))).alias("more_base"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    out = seen.join(more, "rid", "left")
    known = (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0))
    return out.select("doc_id", "row_key", "held_out", "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), F.round("score", 5).alias("score"))
