import math
import random
from collections import Counter

import numpy as np

from lumenary.llm import decontaminate as d
from lumenary.llm.registry import op5_benchmark_leaks

from .conftest import SF


def items(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    text = lambda k: " ".join(rng.choices(words, k=k)).capitalize() + "."
    return words, [(i, f"{text(rng.randint(15, 40))} {text(rng.randint(5, 12))}".encode()) for i in range(n)]


def test_wand_finds_what_scoring_all_items_finds():
    words, bench = items()
    rules = d.Rules(share=0.35)
    index = d.Index(bench, rules)
    bags = {i: d.words_of(t) for i, t in bench}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = Counter(w for b in bags.values() for w in set(b))
    part = lambda w, b: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * Counter(b)[w] * 2.2 / (Counter(b)[w] + 1.2 * (0.25 + 0.75 * len(b) / mean))
    rng = random.Random(1)
    for _ in range(40):
        query = {w.encode() for w in rng.sample(words, rng.randint(20, 100))}
        terms = np.unique([index.term.get(w, 0) for w in query])
        got = {index.ids[k]: s for k, s in index.retrieve(terms[terms > 0])}
        want = {i: sum(part(w, b) for w in set(b) & query) / sum(part(w, b) for w in set(b)) for i, b in bags.items()}
        want = {i: s for i, s in want.items() if s >= rules.share}
        assert got.keys() == want.keys() and all(abs(got[i] - s) < 1e-9 for i, s in want.items())


def test_leaks(spark, docs_of):
    words, bench = items()
    rng = random.Random(2)
    filler = lambda k: " ".join(rng.choices(words, k=k))
    text = {i: t.decode() for i, t in bench}
    near = text[7].split()
    near[3] = "changed"
    question = " ".join(text[9].split()[: len(d.parts_of(bench[9][1])[0])])
    docs = [
        (1, text[5]), (2, f"{filler(3000)} {text[6].upper()} {filler(3000)}"), (3, f"{filler(200)} {' '.join(near)}"), (4, filler(4000)), (5, None), (6, ""), (7, "... !!! ..."),
        (8, question), (9, f"{text[1]} {filler(50)} {text[2]}"), (1, text[5]), (None, text[4].replace(" ", "\n\t")), (10, " ".join(sorted(text[3].split()))),
    ]
    table = spark.createDataFrame([(i, t.decode(), "x") for i, t in bench] + [(500, None, "x"), (501, "", "x"), (502, text[5], "x"), (None, "a b c", "x")], "item_id long, text string, doc_id string")
    got = sorted((str(r.doc_id), r.item_id) for r in d.leaks(docs_of(docs), table).collect())
    assert got == sorted([("1", 5), ("1", 5), ("1", 502), ("1", 502), ("2", 6), ("3", 7), ("9", 1), ("9", 2), ("None", 4)])


def test_items_in_several_indexes_give_the_same(spark, docs_of, monkeypatch):
    _, bench = items(30)
    docs = docs_of([(i, t.decode()) for i, t in bench[:10]])
    table = spark.createDataFrame([(i, t.decode()) for i, t in bench], "item_id long, text string")
    one = sorted((r.doc_id, r.item_id) for r in d.leaks(docs, table).collect())
    monkeypatch.setattr(d, "INDEX_BYTES", 1000)
    assert sorted((r.doc_id, r.item_id) for r in d.leaks(docs, table).collect()) == one == [(i, i) for i in range(10)]


def test_empty_tables(spark, docs_of):
    docs, table = docs_of([(1, "a b c")]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.leaks(docs.limit(0), table).count() == 0 and d.leaks(docs, table.limit(0)).count() == 0


def test_query(spark):
    assert op5_benchmark_leaks(spark, SF).columns == ["doc_id", "item_id", "score", "overlap_percent"]
