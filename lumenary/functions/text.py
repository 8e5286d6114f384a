"""Text analysis: from a text to its terms.

Splitting, the length limit, lower case and stop words are built-in expressions; folding, stemming and the splitters by
segments of scripts run as an Arrow-batched function, which holds the strings of few texts at a time. ``terms`` gives the
same on a Python string, for queries.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stem import stem
from .values import RequestError

TOKENIZERS = ("word_v0", "word_v1", "word_v2", "word_v3", "word_v4", "whitespace", "pre_tokenized_array")
# The 33 English stop words in common use since Lucene's first analyzers.
ENGLISH_STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
SEPARATOR = "\u001f"
#: Terms that an analysing function holds as Python strings; a text of more is held alone.
HELD_TERMS = 50_000
_WORD = r"[\p{IsAlphabetic}\p{N}]+"
_PY = {
    "word": regex.compile(r"[\p{Alphabetic}\p{N}]+"),
    "ideograph": regex.compile(r"[\p{Ideographic}\p{Hiragana}\p{Katakana}]|\p{Extended_Pictographic}(?:\u200d\p{Extended_Pictographic}|[\ufe0f\U0001f3fb-\U0001f3ff])*|[[\p{Alphabetic}\p{N}]--[\p{Ideographic}\p{Hiragana}\p{Katakana}]]+", regex.V1),
    "segment": regex.compile(r"(?w)\b", regex.V1),
    "useful": regex.compile(r"[\p{Alphabetic}\p{N}\p{Extended_Pictographic}]"),
    "space": regex.compile(r"\S+"),
}


@dataclass(frozen=True)
class Analyzer:
    """How a text field becomes terms, and its ranking constants."""

    tokenizer: str = "word_v1"
    language: str = "english"
    stemming: bool = False
    remove_stopwords: bool = False
    case_sensitive: bool = False
    ascii_folding: bool = False
    max_token_length: int | None = None
    stopwords: tuple[str, ...] = ()
    k1: float = 1.2
    b: float = 0.75
    k3: float | None = None

    def __post_init__(self):
        if self.tokenizer not in TOKENIZERS:
            raise RequestError(f"tokenizer {self.tokenizer!r}: one of {', '.join(TOKENIZERS)}")
        if self.stemming and self.language != "english":
            raise RequestError(f"stemming in {self.language!r} isn't supported; english is")
        if self.remove_stopwords and self.language != "english" and not self.stopwords:
            raise RequestError(f"no stop words for {self.language!r}; name them in stopwords")
        if not (0 <= self.k1 <= 3 and 0 <= self.b <= 1 and (self.k3 is None or 0 < self.k3 <= 1000)):
            raise RequestError("k1 is from 0 to 3, b from 0 to 1, k3 above 0 up to 1000")
        if self.max_token_length is not None and not 1 <= self.max_token_length <= 255:
            raise RequestError("max_token_length is from 1 to 255")

    @classmethod
    def declared(cls, options: dict) -> Analyzer:
        """From a ``full_text_search`` declaration."""
        known = {f for f in cls.__dataclass_fields__}
        if other := set(options) - known:
            raise RequestError(f"full_text_search: {sorted(other)[0]!r} is not an option")
        return cls(**{k: tuple(v) if k == "stopwords" else v for k, v in options.items()})

    @property
    def _stop(self) -> tuple[str, ...]:
        return (self.stopwords or ENGLISH_STOP_WORDS) if self.remove_stopwords else ()

    @property
    def _plain_split(self) -> bool:
        """Whether column expressions alone split a text."""
        return self.tokenizer in ("word_v0", "word_v1", "whitespace", "pre_tokenized_array")

    @property
    def built_in(self) -> bool:
        """Whether column expressions alone give the terms."""
        return self._plain_split and not (self.ascii_folding or self.stemming)

    def spans(self, text: str) -> list[tuple[int, int, str | None]]:
        """Start, end and term of each token of a string; None for one that is too long or a stop word."""
        if self.tokenizer == "pre_tokenized_array":
            raw, at = [], 0
            for part in text.split(SEPARATOR):
                if part:
                    raw.append((at, at + len(part)))
                at += len(part) + 1
        elif self.tokenizer in ("word_v3", "word_v4"):
            cuts = [m.start() for m in _PY["segment"].finditer(text)]
            raw = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=False) if _PY["useful"].search(text, a, b)]
        else:
            kind = "space" if self.tokenizer == "whitespace" else "ideograph" if self.tokenizer == "word_v2" else "word"
            raw = [m.span() for m in _PY[kind].finditer(text)]
        return [(a, b, self.term(text[a:b])) for a, b in raw]

    def term(self, token: str, stemmed: bool = True) -> str | None:
        if self.max_token_length is not None and len(token) > self.max_token_length:
            return None
        if not self.case_sensitive:
            token = token.lower()
        if self.ascii_folding:
            token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
        if token in self._stop:
            return None
        return stem(token) if self.stemming and stemmed else token

    def terms(self, value: str | Sequence[str] | None, stemmed: bool = True) -> list[str]:
        """The terms of a string, or of the elements of an array one after another."""
        if value is None:
            return []
        if not isinstance(value, str):
            return [t for v in value if v is not None for t in self.terms(v, stemmed)]
        return [t for a, b, _ in self.spans(value) if (t := self.term(value[a:b], stemmed)) is not None]

    def column(self, text: Column, array: bool = False, stemmed: bool = True) -> Column:
        """The terms of a text column (or of an array of texts) as an array; empty where it is absent."""
        if array:
            if self.tokenizer == "pre_tokenized_array":
                return F.coalesce(self._kept(F.filter(text, lambda x: x.isNotNull())), F.array().cast("array<string>"))
            if self.built_in:
                return F.coalesce(F.flatten(F.transform(F.filter(text, lambda x: x.isNotNull()), lambda x: self._split(x))), F.array().cast("array<string>"))
        elif self.built_in:
            return F.coalesce(self._split(text), F.array().cast("array<string>"))
        own = self

        @F.arrow_udf("array<string>")
        def analysed(v: pa.Array) -> pa.Array:
            return listed(v, lambda x: own.terms(x.as_py(), stemmed))

        return analysed(text)

    def counts(self, df: DataFrame, text: Column) -> DataFrame:
        """term, n: how often each term is in the texts. Words are counted as they are split, before they are folded and
        stemmed, so that Python sees each of them once and no text."""
        if self.built_in or not self._plain_split:
            return df.select(F.explode(self.column(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        words = df.select(F.explode(self._raw(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return words.select("n", F.explode(self.column(F.col("word"))).alias("term")).groupBy("term").agg(F.sum("n").alias("n"))

    def _raw(self, text: Column) -> Column:
        if self.tokenizer == "whitespace":
            return F.filter(F.split(text, r"\p{IsWhite_Space}+"), lambda x: x != "")
        if self.tokenizer == "pre_tokenized_array":
            return F.filter(F.split(text, SEPARATOR), lambda x: x != "")
        return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))

    def _split(self, text: Column) -> Column:
        return self._kept(self._raw(text))

    def _kept(self, raw: Column) -> Column:
        if self.max_token_length is not None:
            raw = F.filter(raw, lambda x: F.length(x) <= self.max_token_length)
        if not self.case_sensitive:
            raw = F.transform(raw, F.lower)
        if self._stop:
            raw = F.filter(raw, lambda x: ~x.isin(*self._stop))
        return raw


def counted(terms: Column) -> Column:
    """The distinct terms of an array in their order, as (term, tf), where tf is how often a term is there."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when(~x.eqNullSafe(F.get(t, i - 1)), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - i).alias("tf"))))

    return bound(F.sort_array(terms), runs)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def listed(values: Iterable, terms: Callable[[object], list[str]]) -> pa.Array:
    """The terms of each value as an Arrow array, of which no more than HELD_TERMS are Python strings at a time."""
    kind = pa.list_(pa.string())
    done, held, n = [], [], 0
    for x in values:
        held.append(terms(x))
        n += len(held[-1])
        if n >= HELD_TERMS:
            done.append(pa.array(held, kind))
            held, n = [], 0
    return pa.concat_arrays([*done, pa.array(held, kind)])


def trigrams(c: Column) -> Column:
    """The distinct trigrams of characters, case folded."""
    low = F.lower(c)
    n = F.length(low)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))))
