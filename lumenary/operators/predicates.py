"""Filter clauses to column expressions.

``["And", [...]]``, ``["Or", [...]]``, ``["Not", clause]`` and ``[attribute, operator, value]``. Every clause is true or
false for every row; a row that lacks the attribute fails it, so ``NotEq`` and the other negations hold there. Equality
and ranges on typed columns stay plain comparisons, which reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, patterns
from ..functions.text import SEPARATOR, Analyzer
from ..functions.values import Attribute, RequestError, compare, holds, kind_of

MAX_PATTERNS = 16
FARTHEST_M = 20_015_087
_PATTERNS = ("Glob", "NotGlob", "IGlob", "NotIGlob", "Regex", "Fuzzy")
_ORDERED = ("Lt", "Lte", "Gt", "Gte")
OPERATORS = (
    "Eq", *_ORDERED, "In", "Contains", "ContainsAny", "AnyLt", "AnyLte", "AnyGt", "AnyGte", "ContainsAllTokens", "ContainsAnyToken", "ContainsTokenSequence",
    "Glob", "IGlob", "Regex", "Fuzzy", "GeoRadius", "GeoBox",
)
NEGATED = ("Eq", "In", "Contains", "ContainsAny", "Glob", "IGlob")


class Filters:
    """Turns clauses into columns over one DataFrame; ``analyzers``: of text attributes, the default one for others.

    ``refs``: columns that ``{"$ref_new": name}`` stands for, in conditions of writes.
    """

    def __init__(self, df: DataFrame, analyzers: Mapping[str, Analyzer] | None = None, refs: Callable[[str], Column] | None = None):
        self.df, self.analyzers, self.refs = df, dict(analyzers or {}), refs
        self.patterns = 0

    def column(self, clause) -> Column:
        """The clause as a Boolean column that is never NULL."""
        self.patterns = 0
        return self._clause(clause)

    def _clause(self, clause) -> Column:
        if not isinstance(clause, (list, tuple)) or not clause:
            raise RequestError("a filter is [\"And\"|\"Or\", [...]], [\"Not\", filter] or [attribute, operator, value]")
        if clause[0] in ("And", "Or") and len(clause) == 2 and isinstance(clause[1], (list, tuple)):
            parts = [self._clause(c) for c in clause[1]]
            if not parts:
                return F.lit(clause[0] == "And")
            return reduce(lambda a, b: a & b if clause[0] == "And" else a | b, parts)
        if clause[0] == "Not" and len(clause) == 2:
            return ~self._clause(clause[1])
        if len(clause) not in (3, 4) or not isinstance(clause[0], str) or not isinstance(clause[1], str):
            raise RequestError("a clause is [attribute, operator, value]")
        name, op, value, *more = clause
        return self._leaf(name, op, value, more[0] if more else {})

    def _leaf(self, name: str, op: str, value, options: dict) -> Column:
        negated = op.startswith("Not") and op != "Not"
        positive = op[3:] if negated else op
        if positive in _PATTERNS:
            self.patterns += 1
            if self.patterns > MAX_PATTERNS:
                raise RequestError(f"a filter has at most {MAX_PATTERNS} patterns")
        if positive not in (NEGATED if negated else OPERATORS):
            raise RequestError(f"{op!r} is not an operator")
        test = getattr(self, f"_{_snake(positive)}")
        a = Attribute.of(self.df, name)
        if isinstance(value, dict) and set(value) == {"$ref_new"}:
            return self._against_new(a, op, value["$ref_new"])
        if a is None:
            out = F.lit(True) if positive == "Eq" and value is None else F.lit(False)
        else:
            out = test(a, value, options) if options or positive.endswith(("Tokens", "Token", "Sequence")) else test(a, value)
        return ~out if negated else out

    def _against_new(self, a: Attribute | None, op: str, name: str) -> Column:
        if self.refs is None:
            raise RequestError("$ref_new stands in conditions of writes only")
        new = self.refs(name)
        own = a.column if a is not None else F.lit(None)
        tests = {"Eq": own == new, "NotEq": ~holds(own == new), "Lt": own < new, "Lte": own <= new, "Gt": own > new, "Gte": own >= new}
        if op not in tests:
            raise RequestError(f"$ref_new doesn't go with {op}")
        return holds(tests[op])

    # Comparisons

    def _eq(self, a: Attribute, v) -> Column:
        if v is None:
            return a.column.isNull()
        return compare(a, "Eq", v)

    def _lt(self, a, v):
        return compare(a, "Lt", v)

    def _lte(self, a, v):
        return compare(a, "Lte", v)

    def _gt(self, a, v):
        return compare(a, "Gt", v)

    def _gte(self, a, v):
        return compare(a, "Gte", v)

    def _in(self, a: Attribute, values) -> Column:
        _array(values, "In")
        if isinstance(a.type, T.StringType) and all(isinstance(v, str) for v in values) and values:
            return a.column.isNotNull() & a.column.isin(*values)  # one set test, which reaches the scan
        return reduce(lambda x, y: x | y, [self._eq(a, v) for v in values], F.lit(False)) if values else F.lit(False)

    # Arrays

    def _any(self, a: Attribute, test: Callable[[Attribute], Column]) -> Column:
        if not a.is_array:
            return F.lit(False)
        return holds(F.exists(a.column, lambda x: test(Attribute(a.name, x, a.type.elementType))))

    def _contains(self, a: Attribute, v) -> Column:
        if v is None:
            return self._any(a, lambda x: x.column.isNull())
        return self._any(a, lambda x: compare(x, "Eq", v))

    def _contains_any(self, a: Attribute, values) -> Column:
        _array(values, "ContainsAny")
        return reduce(lambda x, y: x | y, [self._contains(a, v) for v in values], F.lit(False))

    def _any_lt(self, a, v):
        return self._any(a, lambda x: compare(x, "Lt", v))

    def _any_lte(self, a, v):
        return self._any(a, lambda x: compare(x, "Lte", v))

    def _any_gt(self, a, v):
        return self._any(a, lambda x: compare(x, "Gt", v))

    def _any_gte(self, a, v):
        return self._any(a, lambda x: compare(x, "Gte", v))

    # Tokens

    def _tokens(self, a: Attribute, query, options: dict, holds_for: Callable[[Column, list[str]], Column]) -> Column:
        strings = isinstance(a.type, T.StringType)
        if not strings and not (a.is_array and isinstance(a.type.elementType, T.StringType)):
            return F.lit(False)
        if other := set(options) - {"last_as_prefix"}:
            raise RequestError(f"{sorted(other)[0]!r} is not an option of a token clause")
        own = self.analyzers.get(a.name, Analyzer())
        terms, prefix = own.terms(query), None
        if options.get("last_as_prefix"):
            raw = own.terms(query, stemmed=False)
            terms, prefix = own.terms(query)[:-1] if raw else [], raw[-1] if raw else None
        col = own.column(a.column, array=not strings)
        plain = own.column(a.column, array=not strings, stemmed=False) if prefix else None
        if own.max_token_length is not None and _too_long(query, own):
            return F.lit(False) if holds_for is not _any_of else a.column.isNotNull() & holds_for(col, terms)
        # Bound as an element, so that a text is analysed once however often its terms are looked at.
        out = F.exists(F.array(F.struct(col.alias("t"), (col if plain is None else plain).alias("p"))), lambda x: self._with_prefix(x["t"], x["p"], terms, prefix, holds_for))
        return a.column.isNotNull() & holds(out)

    @staticmethod
    def _with_prefix(col: Column, plain: Column, terms: list[str], prefix: str | None, test) -> Column:
        if prefix is None:
            return test(col, terms)
        begins = lambda t: F.startswith(t, F.lit(prefix))
        if test is _all_of:
            return _all_of(col, terms) & F.exists(plain, begins)
        if test is _any_of:
            return (_any_of(col, terms) if terms else F.lit(False)) | F.exists(plain, begins)
        n = len(terms)
        at = F.sequence(F.lit(1), F.greatest(F.size(col) - n, F.lit(1)))
        run = lambda i: (F.slice(col, i, F.lit(n)) == F.array(*map(F.lit, terms))) if n else F.lit(True)
        return (F.size(col) > n) & F.exists(at, lambda i: run(i) & begins(F.element_at(plain, (i + n).cast("int"))))

    def _contains_all_tokens(self, a, v, options=None):
        return self._tokens(a, v, options or {}, _all_of)

    def _contains_any_token(self, a, v, options=None):
        return self._tokens(a, v, options or {}, _any_of)

    def _contains_token_sequence(self, a, v, options=None):
        own = self.analyzers.get(a.name, Analyzer())
        if a.is_array and own.tokenizer != "pre_tokenized_array" and not (options or {}).get("last_as_prefix"):
            terms = own.terms(v)  # a run lies within one element
            if not own.built_in:
                raise RequestError("a sequence within the elements of an array takes an analyzer without folding and stemming")
            return holds(F.exists(a.column, lambda x: _sequence(own.column(x), terms)))
        return self._tokens(a, v, options or {}, _sequence)

    # Patterns

    def _string(self, a: Attribute) -> Column | None:
        if isinstance(a.type, T.StringType):
            return a.column
        if a.is_variant:
            return F.when(kind_of(a.column) == "string", F.try_variant_get(a.column, "$", "string"))
        return None

    def _glob(self, a, v):
        c = self._string(a)
        return F.lit(False) if c is None else patterns.glob(c, _text(v, "Glob"))

    def _i_glob(self, a, v):
        c = self._string(a)
        return F.lit(False) if c is None else patterns.glob(c, _text(v, "IGlob"), ignore_case=True)

    def _regex(self, a, v):
        c = self._string(a)
        return F.lit(False) if c is None else patterns.matches(c, _text(v, "Regex"))

    def _fuzzy(self, a: Attribute, v, options: dict | None = None) -> Column:
        c = self._string(a)
        o = v if isinstance(v, dict) else {"value": v, **(options or {})}
        if "max_edit_distance" in o:
            ladder = [(int(s["min_query_chars"]), int(s["distance"])) for s in o["max_edit_distance"]]
            return F.lit(False) if c is None else patterns.fuzzy_within(c, _text(o.get("value"), "Fuzzy"), ladder, bool(o.get("case_sensitive", False)))
        if set(o) != {"value", "max_edits"}:
            raise RequestError("Fuzzy takes value and max_edits, or max_edit_distance")
        return F.lit(False) if c is None else patterns.within_edits(c, _text(o["value"], "Fuzzy"), o["max_edits"])

    # Places

    def _geo_radius(self, a: Attribute, v) -> Column:
        lat, lon, metres = _numbers(v, 3, "GeoRadius")
        if not (-90 <= lat <= 90 and -180 <= lon <= 180 and 0 <= metres <= FARTHEST_M):
            raise RequestError("GeoRadius is [latitude, longitude, metres] in range")
        return geo.within_radius(a.column, lat, lon, metres) if _is_point(a) else F.lit(False)

    def _geo_box(self, a: Attribute, v) -> Column:
        south, west, north, east = _numbers(v, 4, "GeoBox")
        if not (-90 <= south <= north <= 90 and -180 <= west <= 180 and -180 <= east <= 180):
            raise RequestError("GeoBox is [south, west, north, east] in range")
        return geo.within_box(a.column, south, west, north, east) if _is_point(a) else F.lit(False)


def _snake(op: str) -> str:
    return "".join("_" + c.lower() if c.isupper() and i else c.lower() for i, c in enumerate(op))


def _array(v, op: str) -> None:
    if not isinstance(v, (list, tuple)):
        raise RequestError(f"{op} takes an array")


def _text(v, op: str) -> str:
    if not isinstance(v, str):
        raise RequestError(f"{op} takes a string")
    return v


def _numbers(v, n: int, op: str) -> list[float]:
    if not isinstance(v, (list, tuple)) or len(v) != n or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in v):
        raise RequestError(f"{op} takes {n} numbers")
    return [float(x) for x in v]


def _is_point(a: Attribute) -> bool:
    return a.is_array and Attribute(a.name, a.column, a.type.elementType).is_number


def _too_long(query, own: Analyzer) -> bool:
    texts = [query] if isinstance(query, str) else query
    return any(b - x > own.max_token_length for t in texts for x, b, _ in own.spans(t))


def _all_of(col: Column, terms: list[str]) -> Column:
    return F.forall(F.array(*map(F.lit, dict.fromkeys(terms))), lambda t: F.array_contains(col, t)) if terms else F.lit(True)


def _any_of(col: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(col, F.array(*map(F.lit, dict.fromkeys(terms)))) if terms else F.lit(False)


def _sequence(col: Column, terms: list[str]) -> Column:
    """A run of terms, as text between separators, which no term holds."""
    if not terms:
        return F.lit(True)
    sep = F.lit(SEPARATOR)
    return F.contains(F.concat(sep, F.array_join(col, SEPARATOR), sep), F.lit(SEPARATOR + SEPARATOR.join(terms) + SEPARATOR))
