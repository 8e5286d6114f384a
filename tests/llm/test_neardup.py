import random

import pytest

from lumenary.llm import neardup
from lumenary.llm.components import components
from lumenary.llm.registry import op7_minhash_neardup

from .brute import near_duplicates
from .conftest import SF


def edited(rng, words, vocabulary, share):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def corpus(seed=4):
    """Copies, near copies about the limit, a hot group of near copies, chains, and odd rows."""
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(3000)]
    rows = []
    put = lambda t: rows.append((len(rows) * 3 + 7, t))
    for _ in range(60):
        base = rng.choices(v, k=rng.randint(8, 200))
        put(" ".join(base))
        for share in (0.0, 0.01, 0.03, 0.05, 0.08):
            if rng.random() < 0.6:
                put(" ".join(edited(rng, base, v, share)))
    hot = rng.choices(v, k=80)
    for _ in range(150):
        put(" ".join(edited(rng, hot, v, 0.015)))
    for _ in range(40):
        put(" ".join(hot).upper())
    chain = rng.choices(v, k=100)
    for i in range(12):
        chain = chain[4:] + rng.choices(v, k=4)
        put(" ".join(chain))
    for t in (None, "", " \t\n", "one", "ONE", "one two", "É two", "é two", "x " * 30_000):
        put(t)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_components_are_those_of_comparing_all(docs_of, size):
    rows = corpus()
    want = near_duplicates(rows, size, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(rows, 5), size=size).collect()}
    assert got == want


def test_smallest_table(spark, sample):
    want = near_duplicates([(d, t) for d, t, _ in sample], 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op7_minhash_neardup(spark, SF).collect()} == want


def test_repeated_rows_null_ids_and_no_rows(docs_of):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (6, "q r s t u v"), (7, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(docs_of(rows)).collect())
    assert got == sorted([("5", 2, "5", True), ("5", 2, "5", True), ("None", 2, "5", False), ("None", 0, "None", True), ("6", 2, "6", True), ("7", 0, "7", True)])
    assert neardup.near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_tensored_keys_come_from_all_pairs_of_half_keys():
    import numpy as np

    h = np.arange(12, dtype=np.uint64).reshape(2, 6)
    keys = neardup.tensored(h, 3)
    assert keys.shape == (2, 9) and len(np.unique(keys)) == 18
    other = h.copy()
    other[0, 0] = 99  # one half-key of the first collection: its three tables differ
    assert (neardup.tensored(other, 3)[0] != keys[0]).sum() == 3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 500)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}


def test_hot_keys_stay_where_they_are_and_all_rows_find_their_facts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("root"))
    facts = rows.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("root <> 1")
    got = neardup._beside(rows, facts, "root")
    assert {(r.id, r.least) for r in got.collect()} == {(i, 0 if i % 3 == 0 else i) for i in range(9000) if i != 1}
    assert got.count() == 8999 and set(got.columns) == {"id", "root", "least"}
