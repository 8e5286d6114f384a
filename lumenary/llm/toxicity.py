"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into buckets; its vector is the mean of their embeddings,
and a passage's the mean of its words' (where it has fewer than ``width``, the others count as zero). A linear softmax
over that gives the passage's class. A text is as toxic as its worst passage of ``width`` words, so that length doesn't
thin out a short insult; a word that repeats itself counts once in a row. In training the gradient goes to the passage
that is worst under the parameters so far, after a first pass over the means of all words of the texts. Misspellings
share n-grams with what they misspell; some words of toxic passages are misspelt at random in training for that.

Scoring needs one number per bucket, as means and the softmax's log-odds are linear.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORD, in_arrow, memory, row_key, stored

MEMO = 300_000
#: Characters of a word that the model sees whole; longer runs are several words to it.
PIECE = 64
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡“”„’…"


@dataclass(frozen=True)
class Settings:
    """``most_toxic``, ``most_clean`` and ``most_bytes`` bound the labelled texts that are gathered for training, which
    takes those with the least hash of their id. Passages are chosen anew by parameters of at most ``refresh`` steps ago."""

    buckets: int = 1 << 17
    dim: int = 12
    shortest: int = 3
    longest: int = 5
    width: int = 8
    epochs: int = 6
    batch: int = 32
    rate: float = 0.3
    refresh: int = 8
    most_toxic: int = 2000
    most_clean: int = 4000
    most_bytes: int = 40 << 20
    threshold: float = 0.3
    seed: int = 1


def buckets_of(word: str, s: Settings) -> list[int]:
    """The word's bag: itself and its n-grams between word ends."""
    w = f"<{word}>".encode("utf-8", "surrogatepass") if word.isascii() else None
    mask = s.buckets - 1
    if w is not None:
        grams = [w[i : i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(w) - n + 1)]
        return [zlib.crc32(g) & mask for g in (w, *grams)]
    p = f"<{word}>"
    grams = [p[i : i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(p) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & mask for g in (p, *grams)]


def once(words: np.ndarray) -> np.ndarray:
    """Without the repeats of what stands just before."""
    return words[np.concatenate(([True], words[1:] != words[:-1]))] if len(words) else words


def clean(word: str) -> str:
    """A word as the model sees it: no marks at its ends."""
    return word.strip(MARKS)


def pieces(text: str, s: Settings) -> list[str]:
    """The words of a text; longer runs without white space, as of scripts that have none, are cut into pieces of PIECE
    characters that overlap by the longest n-gram, each of which counts as a word."""
    words = text.split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    out = []
    for w in words:
        if len(w) > PIECE and len(w := clean(w)) > PIECE:
            out += [w[i : i + PIECE] for i in range(0, len(w) - s.longest, PIECE - s.longest)]
        else:
            out.append(w)
    return out


@dataclass
class Model:
    """Log-odds of a passage: the mean over words of the mean over buckets of ``weight``, and ``bias``."""

    weight: np.ndarray
    bias: float
    settings: Settings


def misspelt(word: str, rng: np.random.Generator) -> str:
    """One random edit: a letter dropped, doubled, swapped or replaced by a mark or digit."""
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    if kind == 0:
        return word[:i] + word[i + 1 :]
    if kind == 1:
        return word[:i] + word[i] + word[i:]
    if kind == 2:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    return word[:i] + "0134$*"[int(rng.integers(6))] + word[i + 1 :]


def train(texts: list[str], toxic: np.ndarray, share: float, s: Settings = Settings()) -> Model:
    """``toxic``: 0 or 1 for each text; ``share``: of toxic ones among all labelled rows, which the sample may not have."""
    rng = np.random.default_rng(s.seed)
    n_toxic = int(toxic.sum())
    prior = log((share + 1e-6) / (1 - share + 1e-6))
    if not n_toxic or n_toxic == len(toxic):
        return Model(np.zeros(s.buckets), prior, s)
    number: dict[str, int] = {}
    docs = [once(np.fromiter((number.setdefault(w, len(number)) for w in map(clean, pieces(t.lower(), s))), np.int32)) for t in texts]
    names, held, ends = list(number), array("i"), array("q", [0])
    for w in names:
        held.extend(buckets_of(w, s))
        ends.append(len(held))
    flat, first = np.frombuffer(held, np.int32), np.frombuffer(ends, np.int64)
    size = np.diff(first)
    emb = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    out, bias = rng.uniform(-0.5, 0.5, (s.dim, 2)), np.array([0.0, log(n_toxic / (len(toxic) - n_toxic))])
    g_emb, g_out, g_bias = np.full(s.buckets, 1e-6), np.full((s.dim, 2), 1e-6), np.full(2, 1e-6)
    order, odds_of = np.flatnonzero([len(d) > 0 for d in docs]), np.zeros(len(names))
    for epoch in range(s.epochs):
        rng.shuffle(order)
        for step, lot in enumerate(order[i : i + s.batch] for i in range(0, len(order), s.batch)):
            if epoch and step % s.refresh == 0:
                odds_of = np.add.reduceat((emb @ (out[:, 1] - out[:, 0]))[flat], first[:-1]) / size
            x, picked = np.zeros((len(lot), s.dim)), []
            for k, d in enumerate(docs[i] for i in lot):
                if epoch and len(d) > s.width:
                    total = np.concatenate(([0.0], np.cumsum(odds_of[d])))
                    at = int(np.argmax(total[s.width :] - total[: -s.width]))
                    d = d[at : at + s.width]
                n, times = max(s.width, len(d)), np.ones(len(d))
                if not epoch:  # a whole text: each of its words once, by how often it is there
                    d, times = np.unique(d, return_counts=True)
                own = [flat[first[w] : first[w + 1]] for w in d]
                if epoch and toxic[lot[k]]:
                    own = [np.array(buckets_of(misspelt(names[w], rng), s), np.int32) if rng.random() < 0.3 else b for w, b in zip(d, own, strict=True)]
                rows, lens = np.concatenate(own), np.array([*map(len, own)])
                weight = np.repeat(times / lens / n, lens)
                x[k] = weight @ emb[rows]
                picked.append((rows, weight))
            logits = x @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(lot)), toxic[lot]] -= 1
            back = p @ out.T
            d_out, d_bias = x.T @ p / len(lot), p.mean(0)
            rows = np.concatenate([r for r, _ in picked])
            u, inv = np.unique(rows, return_inverse=True)
            weight = np.concatenate([w for _, w in picked])
            who = np.repeat(np.arange(len(lot)), [len(r) for r, _ in picked])
            d_emb = np.zeros((len(u), s.dim))
            np.add.at(d_emb, inv, weight[:, None] * back[who])
            g_emb[u] += (d_emb**2).mean(1)
            emb[u] -= s.rate * d_emb / np.sqrt(g_emb[u])[:, None]
            g_out += d_out**2
            out -= s.rate * d_out / np.sqrt(g_out)
            g_bias += d_bias**2
            bias -= 0.1 * d_bias / np.sqrt(g_bias)
    shift = prior - log(n_toxic / (len(toxic) - n_toxic))
    return Model(emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0] + shift), s)


class WordOdds(dict):
    """What a word as written adds, remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.weight, self.settings = model.weight, model.settings

    def __missing__(self, word: str) -> float:
        own = clean(word)
        if own != word:
            out = self[own]
        else:
            b = buckets_of(word, self.settings)
            out = float(self.weight[b].sum()) / len(b)
        if len(self) < MEMO and len(word) <= MEMO_WORD:
            self[word] = out
        return out


def odds(text: str, words: WordOdds, bias: float, width: int) -> float:
    """Log-odds that the text is toxic: those of its worst passage, or the bias where it has no words."""
    own = pieces(text.lower(), words.settings)
    if not own:
        return bias
    per = once(np.fromiter(map(words.__getitem__, own), float, len(own)))  # a word's number tells it well enough
    if len(per) <= width:
        return float(per.sum()) / width + bias
    total = np.concatenate(([0.0], np.cumsum(per)))
    return float((total[width:] - total[:-width]).max()) / width + bias


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _trained(batches: Iterator[pa.RecordBatch], share: float, s: Settings) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).sort_by("doc_id")
    m = train(rows["text"].to_pylist(), (rows["toxic"].to_numpy() > 0).astype(np.int64), share, s)
    yield pa.RecordBatch.from_pydict({"weight": pa.array([m.weight.tobytes()], pa.binary()), "bias": pa.array([m.bias])})


def fitted(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model of the labelled documents that are not held out: a bounded number of them, see Settings.

    Labels without a document, with a null id or a null label are left out; of several labels of one id the largest
    counts. With no label, or those of one class alone, the model gives the share of toxic labels for every text.
    """
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.agg(F.count("*"), F.sum("toxic")).first()
    share = (n[1] or 0) / n[0] if n[0] else 0.0
    order = F.xxhash64("doc_id", F.lit(s.seed))
    picked = own.filter("toxic > 0").orderBy(order, "doc_id").limit(s.most_toxic).unionByName(own.filter("toxic <= 0").orderBy(order, "doc_id").limit(s.most_clean))
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(texts.join(F.broadcast(picked), "doc_id"), "labelled")  # at most most_toxic + most_clean ids
    size = F.octet_length("text").cast("long")
    sized = found.select("doc_id", size.alias("size"), F.xxhash64("text").alias("of"), order.alias("o")).distinct().orderBy("o", "of").limit(s.most_toxic + s.most_clean).collect()
    ids, total = [], 0
    for r in sized:  # in the order of the hash, what fits the bytes
        if total + r.size <= s.most_bytes:
            ids.append((r.doc_id, r.of))
            total += r.size
    if not ids:
        return train([], np.zeros(0, np.int64), share, s)
    kept = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, of long"))
    rows = found.withColumn("of", F.xxhash64("text")).join(kept, ["doc_id", "of"]).dropDuplicates(["doc_id", "of"]).select("doc_id", "text", "toxic")
    # most_bytes of text at most meet in one task, so that the driver needs no memory for them
    got = in_arrow(rows.repartition(1), partial(_trained, share=share, s=s), "weight binary, bias double").first()
    return Model(np.frombuffer(got.weight, float), got.bias, s)


def _scores(texts: pa.Array, name: str, data) -> np.ndarray:
    words = memory("toxicity", name, make=lambda: WordOdds(data.value))
    model = data.value
    logit = np.array([odds(t.as_py() or "", words, model.bias, model.settings.width) for t in texts], float)
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _scored(batches: Iterator[pa.RecordBatch], name: str, data) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {c: b.column(c) for c in ("doc_id", "row_key", "held_out")} | {"score": pa.array(_scores(b.column("text"), name, data))}
        yield pa.RecordBatch.from_pydict(out)


def _clean(batches: Iterator[pa.RecordBatch], name: str, data) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array(_scores(b.column("text"), name, data) < data.value.settings.threshold))


def scored(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, row_key, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0): one row per row of
    ``docs``, of which doc_id, text and source are read (source for row_key alone) and other columns aren't.

    Whole texts are scored, null ones as empty; those without words have the model's bias. Repeated rows have equal
    scores. An empty table gives no rows.
    """
    data = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, s))  # one number a bucket
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), held_out().alias("held_out"), "text")
    out = in_arrow(cols, partial(_scored, name=uuid.uuid4().hex, data=data), "doc_id long, row_key long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))


def clean_rows(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns, in one pass; see `scored`."""
    data = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, s))
    return in_arrow(docs, partial(_clean, name=uuid.uuid4().hex, data=data), docs.schema)
