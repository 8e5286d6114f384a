"""Queries of an index as dictionaries, planned into DataFrames.

A request is either a ranking (vector, multi, text and sparse legs that are fused), an order or expression (``rank_by``),
or an aggregation (``aggregate_by``). A ranking then passes boost, diversify, limit_per and its page, and what the page
shows is computed for the page alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import Analyzer
from ..functions.values import RequestError, unused
from ..operators import aggregate, fusion, ordering, post, projection, retrievers
from ..operators.expressions import Expressions, ranked
from ..operators.predicates import Filters

FIELDS = (
    "vector", "field", "multi", "sparse", "text", "fusion", "filters", "top_k", "offset", "rank_by", "aggregate_by", "group_by", "facets", "boost", "diversify",
    "limit_per", "window", "highlight", "include_attributes", "exclude_attributes", "include_vectors", "vector_encoding", "compute_attributes", "exact", "explain",
)
RANKING = ("vector", "multi", "text", "sparse", "field", "exact", "fusion")
MAX_TOP_K = 10_000


class Index:
    """Rows with an id, attributes and vectors, and how their texts are analysed.

    ``clusters``: a built search structure for ``vector``, used where a query isn't exact and has no filter.
    ``postings``: built inverted indexes by text field, used for every query of words; those that end in a prefix read
    the texts.
    """

    def __init__(self, rows: DataFrame, id_column: str = "id", text: str = "text", vector: str = "vector", sparse: str = "sparse", metric: str = "dot_product", analyzers: Mapping[str, Analyzer] | None = None, clusters: retrievers.Clusters | None = None, encoding: vectors.SetEncoding = vectors.SetEncoding(), postings: Mapping[str, retrievers.Postings] | None = None):
        if id_column != "id":
            rows = rows.withColumnRenamed(id_column, "id")
        if metric not in vectors.METRICS:
            raise RequestError(f"{metric!r} is not a metric")
        self.rows, self.text, self.vector, self.sparse, self.metric = rows, text, vector, sparse, metric
        self.analyzers, self.clusters, self.encoding, self.postings = dict(analyzers or {}), clusters, encoding, dict(postings or {})

    def analyzer(self, field: str) -> Analyzer:
        return self.analyzers.get(field, Analyzer())

    # Parts of requests

    def _stats(self, field: str, terms: Sequence[str]) -> retrievers.FieldStats:
        if field in self.postings:
            return self.postings[field].stats(terms)
        return retrievers.field_stats(self.rows, self.analyzer(field).column(F.col(f"`{field}`"), self.rows.schema[field].dataType.typeName() == "array"), terms)

    def filters(self, df: DataFrame, clause) -> Column | None:
        return None if clause is None else Filters(df, self.analyzers).column(clause)

    def _filtered(self, clause) -> DataFrame:
        test = self.filters(self.rows, clause)
        return self.rows if test is None else self.rows.filter(test)

    def _expressions(self, df: DataFrame) -> Expressions:
        def text_part(field: str, query, options: dict) -> Column:
            own = self.analyzer(field)
            tokens = own.column(F.col(f"`{field}`"), self.rows.schema[field].dataType.typeName() == "array")
            terms, prefix, plain = own.terms(query), None, None
            if options.get("last_as_prefix"):
                raw = own.terms(query, stemmed=False)
                terms, prefix = terms[:-1], raw[-1] if raw else None
                plain = own.column(F.col(f"`{field}`"), False, stemmed=False) if own.stemming else tokens
            return retrievers.bm25_score(tokens, terms, self._stats(field, terms), own, prefix, plain)

        return Expressions(df, Filters(df, self.analyzers), text_part)

    def _text_legs(self, raw) -> list[tuple[str, object, bool]]:
        legs = raw if isinstance(raw, list) else [raw]
        out = []
        for x in legs:
            if isinstance(x, str):
                out.append((self.text, x, False))
            elif isinstance(x, dict) and set(x) <= {"field", "query", "last_as_prefix"} and {"field", "query"} <= set(x):
                out.append((x["field"], x["query"], bool(x.get("last_as_prefix", False))))
            else:
                raise RequestError("text: an entry is a string, or field, query and last_as_prefix")
        if len(out) > fusion.MAX_LEGS - 1:
            raise RequestError(f"text has at most {fusion.MAX_LEGS - 1} legs")
        return out

    def legs(self, q: Mapping) -> list[tuple[str, DataFrame]]:
        """The retrievers of a request in their fixed order: dense, multi, text, sparse."""
        rows = self._filtered(q.get("filters"))
        out: list[tuple[str, DataFrame]] = []
        if q.get("vector") is not None:
            field = q.get("field") or self.vector
            if self.clusters is not None and field == self.vector and not q.get("exact") and q.get("filters") is None:
                out.append(("dense", self.clusters.search(q["vector"])))
            else:
                out.append(("dense", retrievers.dense(rows, field, q["vector"], self.metric)))
        if q.get("multi") is not None:
            m = q["multi"]
            if m.get("mode") == "fde":
                own = unused(rows.columns, "_encoded")
                enc = rows.withColumn(own, self.encoding.column(F.col(m["field"])))
                out.append(("multi", retrievers.multi_encoded(enc, own, m["field"], m["vectors"], self.encoding, m.get("rerank_window") if m.get("rerank") == "exact" else None)))
            else:
                out.append(("multi", retrievers.multi(rows, m["field"], m["vectors"])))
        for field, query, prefix in self._text_legs(q["text"]) if q.get("text") is not None else ():
            if field in self.postings and not prefix:
                found = self.postings[field].search(query, self.analyzer(field))
                out.append(("text", found if q.get("filters") is None else found.join(rows.select("id"), "id", "left_semi")))
            else:
                out.append(("text", retrievers.bm25(rows, field, query, self.analyzer(field), prefix, corpus=self.rows)))
        if q.get("sparse") is not None:
            out.append(("sparse", retrievers.sparse(rows, self.sparse, q["sparse"])))
        return out

    # Requests

    def check(self, q: Mapping) -> None:
        if other := set(q) - set(FIELDS):
            raise RequestError(f"{sorted(other)[0]!r} is not a field of a query")
        top_k, offset = q.get("top_k", 10), q.get("offset", 0) or 0
        if not 0 <= top_k <= MAX_TOP_K or top_k + offset > MAX_TOP_K:
            raise RequestError(f"top_k + offset is at most {MAX_TOP_K}")
        ranks = [f for f in RANKING if q.get(f)]
        if q.get("rank_by") is not None and ranks:
            raise RequestError(f"rank_by can't be combined with {ranks[0]}")
        if q.get("aggregate_by") is not None:
            if bad := [f for f in (*RANKING, "rank_by", "offset", "boost", "diversify", "limit_per", "highlight", "facets", "include_attributes", "exclude_attributes", "include_vectors", "compute_attributes") if q.get(f)]:
                raise RequestError(f"aggregate_by can't be combined with {bad[0]}")
        elif q.get("group_by") is not None:
            raise RequestError("group_by goes with aggregate_by")

    def query(self, q: Mapping) -> DataFrame:
        """The result of a request: an aggregation's groups, or a page of rows with id, rank and score."""
        self.check(q)
        if q.get("aggregate_by") is not None:
            return aggregate.aggregate(self._filtered(q.get("filters")), q["aggregate_by"], q.get("group_by"), q.get("top_k", 10))
        top_k, offset = q.get("top_k", 10), q.get("offset", 0) or 0
        if q.get("rank_by") is not None:
            found = self._by_rank(q, top_k, offset)
        else:
            found = self._by_legs(q, top_k, offset)
        return self._shown(found, q)

    def _by_rank(self, q: Mapping, top_k: int, offset: int) -> DataFrame:
        rows, by = self._filtered(q.get("filters")), q["rank_by"]
        order = not by or isinstance(by[0], list) or (len(by) == 2 and all(isinstance(x, str) for x in by))
        if not order:
            score = self._expressions(rows).column(by)
            return _numbered(ranked(rows, score, top_k, offset), [F.col("score").desc(), F.col("id").asc()], offset)
        keys = ordering.order_keys(rows, ordering.parse_order(by))
        return _numbered(ordering.page(rows, keys, top_k, offset), keys, offset)

    def _by_legs(self, q: Mapping, top_k: int, offset: int) -> DataFrame:
        legs = self.legs(q)
        if not legs:
            raise RequestError("a query has a vector, multi, text, sparse, rank_by or aggregate_by")
        later = any(q.get(f) for f in ("boost", "diversify", "limit_per"))
        window = post.window_of(top_k + offset, q.get("window")) if later else top_k + offset
        how = fusion.Fusion.parse(q.get("fusion"), [k for k, _ in legs])
        fused = fusion.fuse([leg for _, leg in legs], how, window)
        cut = fusion.top(fused, window)
        # at most ``window`` ids, 10,000; the ranking's own columns hide attributes of their names
        out = self.rows.drop("score", "rank", "dist").join(F.broadcast(cut), "id")
        order = [F.col("score").desc(), F.col("id").asc()]
        if q.get("boost"):
            out = post.boosted(out, q["boost"])
        out = out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        if q.get("diversify"):
            d = q["diversify"]
            out = post.diversified(out, d.get("field", self.vector), float(d.get("lambda", 0.5)))
        if q.get("limit_per"):
            out = post.limited(out, q["limit_per"]["attributes"], q["limit_per"]["limit"])
        if len(legs) == 1 and legs[0][0] == "dense":
            out = out.withColumn("dist", projection.vector_distance(out, q.get("field") or self.vector, q["vector"], self.metric))
        return _numbered(out.orderBy("rank").offset(offset).limit(top_k), [F.col("rank").asc()], offset)

    def _shown(self, found: DataFrame, q: Mapping) -> DataFrame:
        always = [c for c in ("id", "rank", "score", "dist") if c in found.columns]
        if q.get("compute_attributes"):
            plain = {k: e for k, e in q["compute_attributes"].items() if not (isinstance(e, (list, tuple)) and e and e[0] == "Highlight")}
            for name, e in q["compute_attributes"].items():
                if name not in plain:
                    found = self._ranked_fragments(found, name, e)
            if plain:
                found = projection.computed(found, plain, self._expressions(found), self.metric)
            always += list(q["compute_attributes"])
        if q.get("highlight") is not None:
            h = projection.Highlight.parse(q["highlight"])
            own = self.analyzer(h.attr)
            terms = [t for _, query, _ in self._text_legs(q["text"]) for t in own.terms(query)] if q.get("text") is not None else []
            found = projection.highlighted(found, h, own, terms)
            always.append("$highlights" if h.structured else "$highlight")
        names = q.get("include_vectors") or []
        if names:
            found = found.withColumns(projection.vector_columns(found, names, q.get("vector_encoding", "float")))
            always += names
        return projection.attributes(found, q.get("include_attributes"), q.get("exclude_attributes"), always)

    def _ranked_fragments(self, found: DataFrame, name: str, e) -> DataFrame:
        """``["Highlight", attr, {rank_fragments_by: [attr, "BM25", query], ...}]``: fragments by the weights that the
        query's terms have in the whole index."""
        _, attr, o = e
        by = o.get("rank_fragments_by")
        if not (isinstance(by, (list, tuple)) and len(by) >= 3 and by[1] == "BM25"):
            raise RequestError('rank_fragments_by is [field, "BM25", query]')
        own = self.analyzer(attr)
        terms = own.terms(by[2])
        stats = self._stats(attr, terms)
        h = projection.Highlight.parse({"attr": attr, "fragment_by": "sentence"} | {k: v for k, v in o.items() if k != "rank_fragments_by"})
        out = projection.highlighted(found, h, own, terms, {t: stats.idf(t) for t in terms})
        return out.withColumnRenamed("$highlights", name)

    def with_clusters(self, path: str, lists: int) -> Index:
        """The index with clusters built for its vectors, from EXACT_BELOW rows on; fewer are searched exactly."""
        if self.rows.count() < retrievers.EXACT_BELOW:
            return self
        c = retrievers.Clusters(self.rows.sparkSession, path, self.vector, self.metric)
        c.build(self.rows, lists)
        return Index(self.rows, "id", self.text, self.vector, self.sparse, self.metric, self.analyzers, c, self.encoding, self.postings)

    def with_postings(self, path: str, *fields: str, buckets: int = 64) -> Index:
        """The index with inverted indexes of some text fields, in folders of their own under ``path``."""
        built = dict(self.postings)
        for i, field in enumerate(fields or (self.text,)):
            built[field] = retrievers.Postings(self.rows.sparkSession, f"{path}/{i}", buckets)
            built[field].build(self.rows, field, self.analyzer(field))
        return Index(self.rows, "id", self.text, self.vector, self.sparse, self.metric, self.analyzers, self.clusters, self.encoding, built)

    def multi_query(self, queries: Sequence[Mapping], rerank_by=None, limit: int = 10, offset: int = 0):
        """Results of up to 16 whole queries, or their reciprocal-rank fusion."""
        if not 1 <= len(queries) <= fusion.MAX_QUERIES:
            raise RequestError(f"1 to {fusion.MAX_QUERIES} queries")
        if any("queries" in q for q in queries):
            raise RequestError("queries don't nest")
        results = [self.query(q) for q in queries]
        if rerank_by is None:
            return results
        if rerank_by[0] != "RRF":
            raise RequestError("results are reranked by RRF; models aren't supported")
        o = rerank_by[1] if len(rerank_by) > 1 else {}
        return fusion.rerank(results, o.get("rank_constant", 60.0), o.get("weights"), limit, offset)

    def facets(self, q: Mapping) -> DataFrame:
        """The facets of a request, over the rows that its filter admits."""
        return aggregate.facets(self._filtered(q.get("filters")), q["facets"])

    def recall(self, queries: Sequence[Sequence[float]], k: int = 10) -> float:
        """The mean share of the exact top k that the clusters find."""
        if self.clusters is None:
            return 1.0
        got = [retrievers.recall(retrievers.dense(self.rows, self.vector, v, self.metric), self.clusters.search(v), k) for v in queries]
        return sum(got) / len(got)

    def explain(self, q: Mapping) -> dict:
        """How a request runs: legs with their mode, limits, and Spark's plan."""
        legs = [] if q.get("rank_by") is not None or q.get("aggregate_by") is not None else self.legs(q)
        ann = self.clusters is not None and not q.get("exact") and q.get("filters") is None
        texts = iter(self._text_legs(q["text"]) if q.get("text") is not None else ())

        def mode(leg: str) -> str:
            if leg == "text":
                field, _, prefix = next(texts)
                return "postings" if field in self.postings and not prefix else "exact"
            return "clusters" if leg == "dense" and ann else "exact"

        plan = self.query(q)._jdf.queryExecution().simpleString()
        return {"legs": [{"leg": k, "mode": mode(k)} for k, _ in legs], "top_k": q.get("top_k", 10), "offset": q.get("offset", 0), "plan": plan}


def _numbered(page: DataFrame, order: Sequence[Column], offset: int) -> DataFrame:
    """Ranks of a page, whose rows are at most MAX_TOP_K."""
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + F.lit(offset))
