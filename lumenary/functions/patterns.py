"""Patterns over strings: globs, regular expressions of a linear-time dialect, and edit distance."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import RequestError, holds

LONGEST = 4096


def glob_regex(pattern: str) -> str:
    """A regular expression for a whole-string glob: * and ?, [..] and [!..], and backslash before a literal."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\":
            if i + 1 == n:
                raise RequestError("a glob doesn't end in a backslash")
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "!" else 2))
            if end < 0:
                raise RequestError("a glob's [ has a ]")
            body = pattern[i + 1 : end]
            negated = body.startswith("!")
            body = "".join("\\" + x if x in "[]\\^&~" else x for x in (body[1:] if negated else body))
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    _limited(pattern)
    flags = "(?isu)" if ignore_case else "(?s)"
    return holds(c.rlike(f"{flags}\\A{glob_regex(pattern)}\\z"))


_REFUSED = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<|[*+?}]\+")


def checked_regex(pattern: str) -> str:
    """The pattern, if it is one that a linear-time engine runs: no look-around, references or possessive repeats."""
    _limited(pattern)
    plain = pattern.replace("\\\\", "")
    plain = re.sub(r"\\\+", "", plain)
    if _REFUSED.search(plain):
        raise RequestError("Regex has no look-around, back-references, atomic groups or possessive repeats")
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\z", "x", pattern))
    except re.error as e:
        raise RequestError(f"Regex: {e}") from e
    return pattern


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern matches anywhere in the string."""
    return holds(c.rlike("(?U)" + checked_regex(pattern)))


def within_edits(c: Column, value: str, most: int) -> Column:
    """Whether the whole string is at most ``most`` (0 to 2) edits of code points from ``value``."""
    if most not in (0, 1, 2):
        raise RequestError("max_edits is 0, 1 or 2")
    return holds(F.levenshtein(c, F.lit(value), most) >= 0)


def substring_edits(text: str, value: str, most: int) -> bool:
    """Whether some substring of ``text`` is within ``most`` edits of ``value``. The distances of the value's prefixes
    to what ends here are held as two sets of bits, where the next prefix is one further and where one nearer, so that
    a character costs a few operations on whole numbers."""
    m = len(value)
    if m <= most:
        return True
    where: dict[str, int] = {}
    for i, ch in enumerate(value):
        where[ch] = where.get(ch, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << m - 1
    up, down, far = full, 0, m
    for ch in text:
        same = where.get(ch, 0)
        level = same | down
        along = (((same & up) + up) ^ up) | same
        rises, falls = down | ~(along | up) & full, up & along
        far += bool(rises & last) - bool(falls & last)
        if far <= most:
            return True
        rises, falls = rises << 1 & full, falls << 1 & full
        up, down = falls | ~(level | rises) & full, rises & level
    return False


def fuzzy_within(c: Column, value: str, ladder: list[tuple[int, int]], case_sensitive: bool = False) -> Column:
    """Substring match within the edits that the ladder (least characters, edits) allows a query of this length; no
    step reached: false."""
    value = value if case_sensitive else value.lower()
    steps = [k for least, k in sorted(ladder) if len(value) >= least]
    if not steps:
        return F.lit(False)
    most = steps[-1]

    @F.pandas_udf("boolean")
    def found(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and substring_edits(x if case_sensitive else x.lower(), value, most))

    return holds(found(c))


def _limited(pattern: str) -> None:
    if len(pattern.encode()) > LONGEST:
        raise RequestError(f"a pattern has at most {LONGEST} bytes")
