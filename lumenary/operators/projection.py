"""What a result row shows: attributes, vectors, computed values and highlights. All of it runs on the page alone."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import Analyzer
from ..functions.values import RequestError
from .expressions import Expressions

MAX_COMPUTED, MAX_VECTOR_ROWS = 256, 1000


def attributes(df: DataFrame, include=None, exclude: Sequence[str] | None = None, always: Sequence[str] = ("id",)) -> DataFrame:
    """``include`` True: all; names: those; neither include nor exclude: none; exclude alone: all others."""
    named = [c for c in df.columns if c not in always]
    if include is True or (include is None and exclude is not None):
        kept = named
    elif isinstance(include, (list, tuple)):
        kept = [c for c in named if c in include]
    else:
        kept = []
    out = [c for c in kept if c not in (exclude or ())]
    return df.select(*[F.col(f"`{c}`") for c in always if c in df.columns], *[F.col(f"`{c}`") for c in out])


def vector_columns(df: DataFrame, names: Sequence[str], encoding: str = "float") -> dict[str, Column]:
    """Columns of vectors as arrays, or as base64 of little-endian floats."""
    if encoding not in ("float", "base64"):
        raise RequestError("vector_encoding is float or base64")
    for n in names:
        if n not in df.columns:
            raise RequestError(f"{n!r} is not a vector field")
    return {n: vectors.to_base64(F.col(n)) if encoding == "base64" and df.schema[n].dataType.simpleString() == "array<float>" else F.col(n) for n in names}


def vector_distance(df: DataFrame, field: str, query: Sequence[float], metric: str) -> Column:
    """The distance to the nearest of the row's vectors, NULL without any."""
    several = df.schema[field].dataType.simpleString().startswith("array<array<")
    each = lambda v: vectors.distance(vectors.score(v, vectors.literal(query), metric), metric)
    return F.array_min(F.transform(F.col(field), each)) if several else each(F.col(field))


def computed(df: DataFrame, named: Mapping[str, object], expressions: Expressions, metric: str = "dot_product") -> DataFrame:
    """Adds a column for each of ``compute_attributes``."""
    if not 1 <= len(named) <= MAX_COMPUTED:
        raise RequestError(f"compute_attributes has 1 to {MAX_COMPUTED} entries")
    cols = {}
    for name, e in named.items():
        if isinstance(e, (list, tuple)) and len(e) == 3 and e[1] == "VectorDist":
            cols[name] = vector_distance(df, e[0], e[2], metric)
        else:
            cols[name] = expressions.column(e, ranks=False)
    return df.withColumns(cols)


# Highlights


@dataclass(frozen=True)
class Highlight:
    """How matches are shown. With ``fragment_by``, ``fragment_limit`` or ``include_offsets`` the result is a list of
    fragments, else one text."""

    attr: str = "text"
    pre: str = "<em>"
    post: str = "</em>"
    max_chars: int = 200
    fragment_by: str | None = None
    fragment_limit: int | None = None
    include_offsets: str | None = None

    @classmethod
    def parse(cls, o: Mapping) -> Highlight:
        if other := set(o) - set(cls.__dataclass_fields__):
            raise RequestError(f"{sorted(other)[0]!r} is not a highlight field")
        h = cls(**o)
        if not h.attr or h.attr == "id" or h.attr.startswith("$"):
            raise RequestError("a highlight reads an attribute")
        if not 1 <= h.max_chars <= 2000:
            raise RequestError("max_chars is from 1 to 2000")
        if h.fragment_by not in (None, "word", "sentence", "paragraph", "none"):
            raise RequestError("fragment_by is word, sentence, paragraph or none")
        if h.fragment_limit is not None and not 0 <= h.fragment_limit <= 16:
            raise RequestError("fragment_limit is from 0 to 16")
        if h.include_offsets not in (None, "utf-8", "utf-16", "codepoints"):
            raise RequestError("include_offsets is utf-8, utf-16 or codepoints")
        return h

    @property
    def structured(self) -> bool:
        return not (self.fragment_by is None and self.fragment_limit is None and self.include_offsets is None)


_MARKS = regex.compile(r"\p{M}*")


def _spans(text: str, analyzer: Analyzer, terms: frozenset[str]) -> list[tuple[int, int, bool]]:
    """Start, end (with combining marks) and whether it matches, of each token."""
    return [(a, _MARKS.match(text, b).end(), t in terms) for a, b, t in analyzer.spans(text)]


def _runs(spans: Sequence[tuple[int, int, bool]], most: int) -> list[tuple[int, int, int]]:
    """For each first token the last one that stays within ``most`` characters, and the matches in between."""
    out, hi, hits = [], 0, [0]
    for s in spans:
        hits.append(hits[-1] + s[2])
    for i, (a, _, _) in enumerate(spans):
        hi = max(hi, i)
        while hi + 1 < len(spans) and spans[hi + 1][1] - a <= most:
            hi += 1
        out.append((i, hi, hits[hi + 1] - hits[i]))
    return out


def _wrapped(text: str, lo: int, hi: int, spans: Sequence[tuple[int, int, bool]], h: Highlight) -> str:
    out, at = [], lo
    for a, b, hit in spans:
        if hit and lo <= a and a < hi:
            out += [text[at:a], h.pre, text[a : min(b, hi)], h.post]
            at = min(b, hi)
    return "".join([*out, text[at:hi]])


def render(text: str, h: Highlight, analyzer: Analyzer, terms: frozenset[str]) -> str:
    """The text with its matches marked, cut to the window of tokens with most matches where it is too long."""
    spans = _spans(text, analyzer, terms)
    if len(text) <= h.max_chars:
        return _wrapped(text, 0, len(text), spans, h)
    if not spans:
        return text[: h.max_chars] + "…"
    i, j, _ = max(_runs(spans, h.max_chars), key=lambda r: (r[2], -r[0]))
    lead = "…" if i else ""
    a, b, hit = spans[i]
    if b - a > h.max_chars:
        cut = text[a : a + h.max_chars]
        return f"{lead}{h.pre + cut + h.post if hit else cut}…"
    return f"{lead}{_wrapped(text, a, spans[j][1], spans[i : j + 1], h)}{'…' if j + 1 < len(spans) else ''}"


def _units(text: str, by: str) -> list[tuple[int, int]]:
    """Sentences, paragraphs, or the whole, without white space at their ends."""
    if by in ("word", "none"):
        cuts = []
    else:
        stop = r"\s*\n\s*" if by == "paragraph" else r"\s*\n\s*|(?<=[.!?])(?=\s)|(?<=[。！？])"
        cuts = [m.span() for m in re.finditer(stop, text)]
    out, at = [], 0
    for a, b in [*cuts, (len(text), len(text))]:
        part = text[at:a]
        if part.strip():
            out.append((at + len(part) - len(part.lstrip()), a - (len(part) - len(part.rstrip()))))
        at = b
    return out


def _offset(text: str, at: int, units: str) -> int:
    if units == "utf-8":
        return len(text[:at].encode())
    return len(text[:at].encode("utf-16-le")) // 2 if units == "utf-16" else at


def fragments(value, h: Highlight, analyzer: Analyzer, terms: frozenset[str], weight=None) -> list[dict] | None:
    """The best fragments, each at most ``max_chars`` long (but with "none" whole): by ``weight(text, matches)`` or the
    number of matches, ties to the earlier, none that overlaps a better one, one without a match only if none has any."""
    texts = [value] if isinstance(value, str) else [v for v in value or [] if isinstance(v, str)]
    by, limit = h.fragment_by or "word", 1 if h.fragment_limit is None else h.fragment_limit
    found = []
    for n, text in enumerate(texts):
        spans = _spans(text, analyzer, terms)
        for lo, hi in _units(text, by):
            own = [s for s in spans if lo <= s[0] < hi]
            if by != "none" and hi - lo > h.max_chars:
                if by == "word":
                    found += [(n, own[i][0], min(own[j][1], own[i][0] + h.max_chars), k) for i, j, k in _runs(own, h.max_chars)]
                    continue
                if own:
                    i, j, _ = max(_runs(own, h.max_chars), key=lambda r: (r[2], -r[0]))
                    lo, hi = own[i][0], min(own[j][1], own[i][0] + h.max_chars)
                else:
                    hi = lo + h.max_chars
            found.append((n, lo, hi, sum(s[2] for s in spans if lo <= s[0] < hi)))
    if not found:
        return None
    score = [weight(texts[n][a:b], k) if weight else k for n, a, b, k in found]
    taken: list[int] = []
    for c in sorted(range(len(found)), key=lambda c: (-score[c], c)):
        if len(taken) >= limit or (score[c] <= 0 and taken):
            break
        n, a, b, _ = found[c]
        if all(found[t][0] != n or b <= found[t][1] or found[t][2] <= a for t in taken):
            taken.append(c)
    out = []
    for n, a, b, _ in (found[c] for c in taken):
        spans = _spans(texts[n], analyzer, terms)
        marks = [(x, min(y, b)) for x, y, hit in spans if hit and a <= x < b]
        place = (lambda p, t=texts[n]: _offset(t, p, h.include_offsets)) if h.include_offsets else None
        out.append({
            "text": _wrapped(texts[n], a, b, spans, h),
            "fragment_range": [place(a), place(b)] if place else None,
            "match_ranges": [[place(x), place(y)] for x, y in marks] if place else None,
            "array_index": None if isinstance(value, str) else n,
        })
    return out


FRAGMENTS = "array<struct<text:string,fragment_range:array<int>,match_ranges:array<array<int>>,array_index:int>>"


def highlighted(df: DataFrame, h: Highlight, analyzer: Analyzer, terms: Sequence[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Adds ``$highlight`` or ``$highlights``; ``weights``: of terms, by which fragments are ranked instead of by their
    number of matches."""
    known = frozenset(terms)
    if h.attr not in df.columns:
        return df.withColumn("$highlights" if h.structured else "$highlight", F.lit(None).cast(FRAGMENTS if h.structured else "string"))
    if not h.structured and weights is None:

        @F.pandas_udf("string")
        def marked(v: pd.Series) -> pd.Series:
            return v.map(lambda x: render(x, h, analyzer, known) if isinstance(x, str) else None)

        return df.withColumn("$highlight", marked(F.col(f"`{h.attr}`")))
    by_term = dict(weights or {})
    weight = (lambda text, n: sum(by_term.get(t, 0.0) for t in analyzer.terms(text))) if weights is not None else None

    pick = F.udf(lambda x: fragments(x, h, analyzer, known, weight), FRAGMENTS, useArrow=True)
    return df.withColumn("$highlights", pick(F.col(f"`{h.attr}`")))
