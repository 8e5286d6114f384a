"""Retrievers: rows scored by dense vectors, sets of vectors, text or sparse vectors.

Each gives a DataFrame with the columns of its input and ``score``. Queries are literals, so scoring is a projection of
the scan; the only shuffles are one grouped aggregate of statistics and the bounded top-k. Where many queries meet an
index, ``Postings`` and ``Clusters`` keep tables whose files a query's terms or probes prune.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import Analyzer, bound, counted
from ..functions.values import RequestError, unused

#: Below so many rows a search is exact, without clusters.
EXACT_BELOW = 25_000
LARGEST_WEIGHT = 65_504


def dense(df: DataFrame, vector: str, query: Sequence[float], metric: str = "dot_product") -> DataFrame:
    """Every row with a vector of the query's width, by its score under the metric."""
    if metric == "cosine_distance" and not any(query):
        raise RequestError("a zero vector has no direction")
    if not all(math.isfinite(x) for x in query):
        raise RequestError("a vector's components are finite")
    rows = df.filter(F.size(vector) == len(query))
    return rows.withColumn("score", vectors.query_score(F.col(vector), query, metric)).filter(F.col("score").isNotNull())


def brute_force(df: DataFrame, vector: str, query: Sequence[float], k: int, id_column: str = "id") -> DataFrame:
    """The k rows with the least squared distance, ties by id."""
    rows = df.filter(F.size(vector) == len(query))
    out = rows.withColumn("distance", -vectors.query_score(F.col(vector), query, "euclidean_squared"))
    return out.orderBy(F.col("distance").asc(), F.col(id_column).asc()).limit(k)


def many_queries(df: DataFrame, vector: str, queries: Sequence[Sequence[float]], k: int, metric: str = "dot_product", id_column: str = "id") -> DataFrame:
    """query, id, score, rank: the top k of each query. Each query is a literal and a search of its own that keeps a
    heap of k in each task; rows and queries are never paired."""
    scored = None
    for i, q in enumerate(queries):
        part = dense(df, vector, q, metric).select(F.lit(i).alias("query"), F.col(id_column).alias("id"), "score").orderBy(F.col("score").desc(), F.col("id").asc()).limit(k)
        scored = part if scored is None else scored.unionByName(part)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc())))


def multi(df: DataFrame, vector_sets: str, query: Sequence[Sequence[float]]) -> DataFrame:
    """Late interaction, exact: rows without vectors aren't scored."""
    return df.withColumn("score", vectors.max_sim(F.col(vector_sets), query)).filter(F.col("score").isNotNull())


def multi_encoded(df: DataFrame, encoded: str, vector_sets: str, query: Sequence[Sequence[float]], encoding: vectors.SetEncoding, rerank_window: int | None = None, id_column: str = "id") -> DataFrame:
    """Late interaction by encodings of sets: their product, and of the best ``rerank_window`` rows the exact sum."""
    q = encoding.encode(query, False).tolist()
    out = df.filter(F.size(encoded) > 0).withColumn("score", vectors.dot(F.col(encoded), vectors.literal(q)))
    if rerank_window is None:
        return out
    cut = out.orderBy(F.col("score").desc(), F.col(id_column).asc()).limit(rerank_window)
    return multi(cut.drop("score"), vector_sets, query)


def sparse(df: DataFrame, weights: str, query: Mapping[str, float]) -> DataFrame:
    """The products of the weights of shared keys, for every row that shares a key, whatever the sign."""
    if not query or any(not math.isfinite(w) or abs(w) > LARGEST_WEIGHT for w in query.values()):
        raise RequestError(f"a sparse vector has keys with finite weights up to {LARGEST_WEIGHT}")

    def product(m: Column) -> Column:
        own = [(F.try_element_at(m, F.lit(k)), w) for k, w in query.items()]
        shared = reduce(lambda a, b: a | b, [v.isNotNull() for v, _ in own])
        return F.when(shared, reduce(lambda a, b: a + b, [F.coalesce(v.cast("double") * F.lit(float(w)), F.lit(0.0)) for v, w in own]))

    # Bound, so that weights that are computed are computed once however many keys look at them.
    return df.withColumn("score", bound(F.col(weights), product)).filter(F.col("score").isNotNull())


# Text


@dataclass(frozen=True)
class FieldStats:
    """Statistics of a text field over all rows of an index: rows (textless ones too), terms, and rows by term."""

    rows: int
    terms: int
    by_term: Mapping[str, int]

    def idf(self, term: str) -> float:
        df = self.by_term.get(term, 0)
        return math.log(1 + (self.rows - df + 0.5) / (df + 0.5))

    @property
    def mean(self) -> float:
        return self.terms / self.rows if self.rows and self.terms else 1.0


def field_stats(df: DataFrame, tokens: Column, terms: Sequence[str]) -> FieldStats:
    """In one aggregate without a shuffle of rows; filters of a query don't restrict it."""
    own = list(dict.fromkeys(terms))
    r = df.select(tokens.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("terms"), *[F.sum(F.array_contains("t", x).cast("long")).alias(f"t{i}") for i, x in enumerate(own)]).first()
    return FieldStats(r.n, r.terms or 0, {x: r[f"t{i}"] or 0 for i, x in enumerate(own)})


def _is(term: str):
    return lambda x: x == F.lit(term)


def bm25_score(tokens: Column, query: Sequence[str], stats: FieldStats, analyzer: Analyzer = Analyzer(), prefix: str | None = None, plain: Column | None = None) -> Column:
    """The score, NULL where no term occurs. Repeated query terms count once, or by their saturated count under k3. A
    ``prefix`` that some plain term begins with adds 1."""
    both = F.struct(tokens.alias("t"), (tokens if plain is None else plain).alias("p"))
    # Bound as an element, so that a text is analysed once however many terms look at it.
    return F.element_at(F.transform(F.array(both), lambda x: _bm25_of(x["t"], x["p"], query, stats, analyzer, prefix)), 1)


def _bm25_of(tokens: Column, plain: Column, query: Sequence[str], stats: FieldStats, analyzer: Analyzer, prefix: str | None) -> Column:
    k1, b = analyzer.k1, analyzer.b
    length = F.size(tokens) / F.lit(stats.mean)
    parts, any_ = [], []
    for term, times in Counter(query).items():
        tf = F.size(F.filter(tokens, _is(term))).cast("double")
        weight = 1.0 if analyzer.k3 is None else (analyzer.k3 + 1) * times / (analyzer.k3 + times)
        parts.append(F.lit(stats.idf(term) * weight) * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length)))
        any_.append(F.array_contains(tokens, term))
    if prefix is not None:
        begins = F.exists(plain, lambda t: F.startswith(t, F.lit(prefix)))
        parts.append(begins.cast("double"))
        any_.append(begins)
    if not parts:
        return F.lit(None).cast("double")
    if k1 == 0:  # 0 / 0 where the term doesn't occur
        parts = [F.when(a, F.coalesce(p, F.lit(0.0))).otherwise(F.lit(0.0)) for a, p in zip(any_, parts, strict=True)]
    return F.when(reduce(lambda x, y: x | y, any_), reduce(lambda x, y: x + y, parts))


def bm25(df: DataFrame, text: str, query, analyzer: Analyzer = Analyzer(), last_as_prefix: bool = False, corpus: DataFrame | None = None) -> DataFrame:
    """Rows with a term of the query. ``corpus``: the unfiltered rows that the statistics are of."""
    array = df.schema[text].dataType.typeName() == "array"
    tokens = analyzer.column(F.col(text), array)
    terms, prefix, plain = analyzer.terms(query), None, None
    if last_as_prefix:
        raw = analyzer.terms(query, stemmed=False)
        terms, prefix = terms[:-1], raw[-1] if raw else None
        plain = analyzer.column(F.col(text), array, stemmed=False) if analyzer.stemming else tokens
    stats = field_stats(corpus if corpus is not None else df, tokens, terms)
    return df.withColumn("score", bm25_score(tokens, terms, stats, analyzer, prefix, plain)).filter(F.col("score").isNotNull())


class Postings:
    """An inverted index as a table: (bucket, term, id, tf, length), in one folder a bucket and sorted by term, so that a
    query reads the row groups of its terms alone. Beside it are the field's totals, so that statistics read no text."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets, self._known = spark, path, buckets, None

    def build(self, df: DataFrame, text: str, analyzer: Analyzer = Analyzer(), id_column: str = "id") -> None:
        """Terms are counted in their row, so that only postings are shuffled, once and unsorted. They are dealt by bucket
        and salt, and adaptive execution splits what is large and joins what is small, so that a task sorts a bounded
        part of a bucket however large the table or frequent a term is."""
        tokens = analyzer.column(F.col(f"`{text}`"), df.schema[text].dataType.typeName() == "array")
        rows = df.select(F.col(f"`{id_column}`").alias("id"), tokens.alias("t")).withColumn("length", F.size("t"))
        each = rows.select("id", "length", F.explode(counted(F.col("t"))).alias("x")).select("id", "x.term", "length", "x.tf")
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        dealt = each.withColumns({"bucket": bucket, "salt": F.pmod(F.xxhash64("id"), F.lit(8))}).hint("rebalance", "bucket", "salt").drop("salt")
        dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        self._known = None
        id_type = F.lit(df.schema[id_column].dataType.simpleString()).alias("id_type")
        rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms")).select("*", id_type).write.mode("overwrite").parquet(f"{self.path}/totals")

    def _totals(self):
        if self._known is None:
            self._known = self.spark.read.parquet(f"{self.path}/totals").first()
        return self._known

    def _of(self, terms: Sequence[str], id_type: str) -> DataFrame:
        """The postings of some terms, from their buckets' folders alone. An index without terms has no files."""
        buckets = [F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms]  # constants, which prune folders
        all_ = self.spark.read.schema(f"id {id_type}, term string, length int, tf int, bucket int").parquet(f"{self.path}/postings")
        return all_.filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))

    def _stats(self, totals, own: DataFrame | None) -> FieldStats:
        rows = own.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect() if own is not None else []  # a row a term of the query
        return FieldStats(totals.rows, totals.terms, {r.term: r.n for r in rows})

    def stats(self, terms: Sequence[str]) -> FieldStats:
        """What `field_stats` gives, without a look at the texts."""
        own, totals = list(dict.fromkeys(terms)), self._totals()
        return self._stats(totals, self._of(own, totals.id_type) if own else None)

    def search(self, query, analyzer: Analyzer = Analyzer()) -> DataFrame:
        """id, score: the postings of the query's terms, added up by id in the order of the terms, so that scores are
        those of `bm25` to the last bit and equal texts tie."""
        terms, totals = Counter(analyzer.terms(query)), self._totals()
        if not terms:
            return self.spark.createDataFrame([], f"id {totals.id_type}, score double")
        own = self._of(list(terms), totals.id_type)
        stats = self._stats(totals, own)
        tf, length = F.col("tf").cast("double"), F.col("length") / F.lit(stats.mean)
        parts = []
        for i, (term, times) in enumerate(terms.items()):
            weight = 1.0 if analyzer.k3 is None else (analyzer.k3 + 1) * times / (analyzer.k3 + times)
            part = F.lit(stats.idf(term) * weight) * tf * F.lit(analyzer.k1 + 1) / (tf + F.lit(analyzer.k1) * (F.lit(1 - analyzer.b) + F.lit(analyzer.b) * length))
            parts.append(F.sum(F.when(F.col("term") == term, part)).alias(f"p{i}"))  # of one row where ids are unique
        total = reduce(lambda a, b: a + b, [F.coalesce(f"p{i}", F.lit(0.0)) for i in range(len(parts))])
        return own.groupBy("id").agg(*parts).select("id", total.alias("score"))


# Approximate dense search


class Clusters:
    """Rows dealt to the nearest of k-means centres, one folder a list: a query reads the folders of its nearest centres
    and scores what is there exactly."""

    def __init__(self, spark: SparkSession, path: str, vector: str = "vector", metric: str = "dot_product"):
        self.spark, self.path, self.vector, self.metric = spark, path, vector, metric

    @staticmethod
    def _unit(c: Column) -> Column:
        n = F.sqrt(vectors.norm_squared(c))
        return F.when(n > 0, F.transform(c, lambda x: x.cast("double") / n)).otherwise(c.cast("array<double>"))

    def build(self, df: DataFrame, lists: int, sample: int = 200_000, seed: int = 1) -> None:
        """Centres come from a bounded sample; every row is dealt to a list."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        unit = self._unit(F.col(self.vector)) if self.metric == "cosine_distance" else F.col(self.vector).cast("array<double>")
        own = unused(df.columns, "_features")
        rows = df.filter(F.size(self.vector) > 0).withColumn(own, array_to_vector(unit))
        n = rows.count()
        some = rows.sample(min(1.0, sample / n), seed) if n > sample else rows
        model = KMeans(k=max(1, min(lists, n)), seed=seed, featuresCol=own, predictionCol="list_id", maxIter=15).fit(some.select(own))
        model.transform(rows).drop(own).repartition("list_id", F.pmod(F.xxhash64(*df.columns[:1]), F.lit(4))).write.mode("overwrite").partitionBy("list_id").parquet(f"{self.path}/rows")
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        self.spark.createDataFrame(centres, "list_id int, centre array<double>").write.mode("overwrite").parquet(f"{self.path}/centres")

    def probes(self, query: Sequence[float], p: int = 8, slack: float | None = None) -> list[int]:
        """The lists to read: the p nearest centres, and of those the ones within ``slack`` of the nearest's distance."""
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect())  # a row a list
        centres, q = np.array([r.centre for r in rows]), np.asarray(query, float)
        if self.metric == "cosine_distance":
            q = q / np.linalg.norm(q)
        far = -(centres @ q) if self.metric == "dot_product" else ((centres - q) ** 2).sum(1)
        near = np.argsort(far, kind="stable")[:p]
        if slack is not None and self.metric != "dot_product":
            near = near[far[near] <= far[near[0]] * (1 + slack)]
        return [rows[i].list_id for i in near]

    def search(self, query: Sequence[float], p: int = 8, slack: float | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("list_id").isin(self.probes(query, p, slack)))
        return dense(rows, self.vector, query, self.metric)


def recall(exact: DataFrame, found: DataFrame, k: int, id_column: str = "id") -> float:
    """The share of the exact top k that the other search has found."""
    top = lambda d: d.orderBy(F.col("score").desc(), F.col(id_column).asc()).limit(k).select(id_column)
    want = top(exact)
    n = want.count()
    return want.join(top(found), id_column, "left_semi").count() / n if n else 1.0


def refuse_trigrams(*_):
    raise RequestError("the trigram leg isn't supported")
