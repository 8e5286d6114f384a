"""Token counts by trie-shared dynamic programming.

Distinct pre-tokens (words with the mark of a word's beginning) go into a trie. Along each edge, once for all words
with that prefix, the best score of a unigram segmentation of the prefix is computed from those of shorter prefixes on
the same path, with the fewest tokens that reach it; a word's end stores the count. The pieces that end at a prefix are
found by walking back over it in a second trie, of the pieces' reversals. A text's count is the sum over its words; the
words of many texts share a trie, and frequent words are remembered, so that a task's memory is bounded. Pieces come from a public vocabulary file; as it has ranks but no probabilities, piece r of n has the
Zipf-Mandelbrot log-probability -log((r + 2.7) * H), H normalising over the pieces. A character that no piece covers
takes one token per byte, as in vocabularies with byte fallback.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import islice
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, memory
from .tokens import vocabulary

BEGIN = "▁"
#: Words whose counts a worker remembers; it keeps the first, which hold the frequent ones.
MEMO, MEMO_BYTES = 300_000, 16 << 20
#: New words of a trie, their bytes, and words of the texts that wait for it, at most (by one text more).
TRIE_WORDS, TRIE_BYTES, LOT_WORDS = 200_000, 4 << 20, 4_000_000
MANDELBROT = 2.7


@dataclass(frozen=True)
class Pieces:
    """Log-probabilities by piece, of a byte, and the longest piece's length. ``back``: see
    `reversals`."""

    score: dict[str, float]
    byte: float
    longest: int
    back: dict


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    norm = log(sum(1 / (r + MANDELBROT) for r in range(len(own))))
    score = {p: -log(r + MANDELBROT) - norm for r, p in enumerate(own)}
    return Pieces(score, min(score.values()) - 4.0, max(map(len, own)), reversals(score))


def reversals(score: dict[str, float]) -> dict[str, tuple]:
    """The trie of the reversed pieces: by character, the score of the piece that is whole there and what precedes it;
    None stands for no piece and for nothing."""
    by_last: dict[str, dict[str, float]] = {}
    for p, x in score.items():
        by_last.setdefault(p[-1], {})[p[:-1]] = x
    return {c: (rest.pop("", None), reversals(rest) if rest else None) for c, rest in by_last.items()}


class Node:
    """A prefix: its best score and the fewest tokens with it."""

    __slots__ = ("score", "tokens")

    def __init__(self, score: float, tokens: int):
        self.score, self.tokens = score, tokens


def trie_counts(words: list[str], own: Pieces) -> dict[str, int]:
    """Tokens of each distinct word. The trie of the words is walked depth first, which is their sorted order: each node
    is scored once, and only those on the way to the word at hand are held."""
    out, last, path, before = {}, own.back, [Node(0.0, 0)], ""
    for word in sorted(words):
        text = BEGIN + word
        shared = 0
        for a, b in zip(text, before):  # noqa: B905
            if a != b:
                break
            shared += 1
        del path[shared + 1 :]
        node, before = path[-1], text
        for i in range(shared, len(text)):
            c = text[i]
            if c < "\x80":
                best, tokens = node.score + own.byte, node.tokens + 1
            else:
                n = len(c.encode("utf-8", "surrogatepass"))
                best, tokens = node.score + n * own.byte, node.tokens + n
            at, j = last.get(c), i
            while at is not None:
                s, before_it = at
                if s is not None:
                    from_ = path[j]
                    s += from_.score
                    if s > best or s == best and from_.tokens + 1 < tokens:
                        best, tokens = s, from_.tokens + 1
                if before_it is None or not j:
                    break
                j -= 1
                at = before_it.get(text[j])
            node = Node(best, tokens)
            path.append(node)
        out[word] = node.tokens
    return out


class Counts(dict):
    """Counts of words, remembered up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        self.pieces = pieces(path)

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts of new words in sorted order; their trie lives as long as this call."""
        new = trie_counts(list(words), self.pieces)
        if len(self) < MEMO:
            self.update(new)
        return new


class Numbers(dict):
    """Numbers of words as bytes, in the order in which they come; those below ``known`` have their counts in ``counts``."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.counts, self.known, self.bytes, self.new_bytes = path, np.zeros(0, np.int64), 0, 0, 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new_bytes += len(word)
        return n

    def settle(self) -> np.ndarray:
        """Counts by number: one trie for all new words. Afterwards the first MEMO words are known, or fewer long ones."""
        new = [w.decode("utf-8", "replace") for w in islice(self, self.known, None)]
        found = trie_counts(list(set(new)), pieces(self.path))
        counts = np.concatenate((self.counts, np.fromiter(map(found.__getitem__, new), np.int64, len(new))))
        self.bytes += self.new_bytes
        while len(self) > MEMO or self.bytes > MEMO_BYTES:
            self.bytes -= len(self.popitem()[0])
        self.known, self.counts, self.new_bytes = len(self), counts[: len(self)], 0
        return counts


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    numbers = memory("counts", path, make=lambda: Numbers(path))
    ids, each, lens, waiting = [], [], [], 0

    def settled() -> pa.RecordBatch:
        nonlocal waiting
        counts = numbers.settle()
        n = np.array(lens, np.int64)
        ends = np.concatenate(([0], np.cumsum(n)))
        total = np.concatenate(([0], np.cumsum(counts[np.concatenate(each)])))[ends]
        out = pa.RecordBatch.from_pydict({"doc_id": pa.concat_arrays(ids), "n_words": pa.array(n), "n_tokens": pa.array(np.diff(total))})
        ids.clear(), each.clear(), lens.clear()
        waiting = 0
        return out

    for b in batches:
        at = 0
        for k, t in enumerate(b.column("text").cast(pa.binary())):
            words = (t.as_py() or b"").split()
            each.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            lens.append(len(words))
            waiting += len(words)
            if len(numbers) - numbers.known >= TRIE_WORDS or numbers.new_bytes >= TRIE_BYTES or waiting >= LOT_WORDS:
                ids.append(b.column("doc_id").slice(at, k + 1 - at))
                at = k + 1
                yield settled()
        if at < len(b):
            ids.append(b.column("doc_id").slice(at))
    if lens:
        yield settled()


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens: one row per row of ``docs``, of which doc_id and text are read and other columns aren't.

    A null or empty text, or one of white space, has 0 of both. Repeated rows have equal counts. An empty table gives no
    rows. Words are what stands between ASCII white space. ``path`` is a sentencepiece vocabulary.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(cols, partial(_counted, path=path or vocabulary("piece_bpe_32k.model")), "doc_id long, n_words long, n_tokens long")
