import random
import zlib

import numpy as np
import pytest

from lumenary.llm import toxicity
from lumenary.llm.registry import op3_toxicity

from .conftest import SF

SMALL = toxicity.Settings(buckets=1 << 14, epochs=4)
BAD = ["awfulness", "scoundrel", "rottenness", "vermin"]


def corpus(n=400):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(20, 200))
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = rng.choices(BAD, k=4)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark, docs_of):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "???  !!!"), (None, "hello there"), (1003, rows[4][1]), (1003, rows[4][1]), (1004, "fine words " * 40_000)]
    marks = spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    return rows, labels, {r.doc_id: r for r in toxicity.scored(docs_of(rows), marks, SMALL).collect()}


def test_held_out_documents_are_told_apart(scored):
    _, labels, got = scored
    mine = [(got[d], t) for d, _, t in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(mine) > 50 and all(r.held_out for r, _ in mine)
    assert sum(r.predicted == t for r, t in mine) >= 0.95 * len(mine)


def test_scores_of_odd_rows(scored):
    rows, _, got = scored
    assert len(got) == len({r[0] for r in rows})
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[1000].score == got[1001].score and got[1003].score == got[4].score and not got[None].held_out


def test_unseen_misspellings_count(scored, spark, docs_of):
    rows, labels, _ = scored
    docs = docs_of([(d, t) for d, t in rows if d is not None])
    m = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), SMALL)
    words = toxicity.WordOdds(m)
    assert all(words[x] > np.median([words[w] for _, t in rows[1:4] for w in t.split()]) for x in ("awfulnness", "scoundr3l", "verrmin"))


def test_one_class_no_labels_and_no_rows(spark, docs_of):
    docs, none = docs_of([(1, "a b"), (2, "c d")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.scored(docs, none, SMALL).collect()} == {0}
    assert toxicity.scored(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), SMALL).count() == 2
    assert toxicity.scored(docs.limit(0), none, SMALL).count() == 0


def test_query_learns_from_no_held_out_row(spark):
    out = op3_toxicity(spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == 200


def test_all_of_a_long_run_counts():
    rng = random.Random(8)
    run = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(100, 400)))
    texts, toxic = [], np.array([i % 2 for i in range(200)])
    for bad in toxic:
        x = run()
        texts.append(x + "-" + "_".join(rng.choices(BAD, k=8)) + run()[:90] if bad else x + run())
    words = toxicity.WordOdds(m := toxicity.train(texts[:150], toxic[:150], 0.5, SMALL))
    got = np.array([toxicity.odds(t, words, m.bias, SMALL.width) > 0 for t in texts[150:]])
    assert (got == toxic[150:]).mean() >= 0.9
    grams = lambda w: {w[i : i + n] for n in range(SMALL.shortest, SMALL.longest + 1) for i in range(len(w) - n + 1)}
    for n in (64, 65, 69, 70, 123, 124, 1000):
        w = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(n))
        p = toxicity.pieces(f"«{w}»!", SMALL)
        assert set().union(*map(grams, map(toxicity.clean, p))) == grams(w) and max(map(len, map(toxicity.clean, p))) <= 64


def test_scores_are_those_of_a_plain_computation(scored, spark, docs_of):
    """Mean of the buckets of a word, sum over the worst 8 words by 8, bias, logistic."""
    rows, labels, _ = scored
    docs = [(d, t) for d, t in rows if d is not None][:60] + [(2000, "x" * 10_000), (2001, "x" * 9_999 + "y"), (2002, "same same same other other"), (2003, "«Mixed» CASE, words! " * 3)]
    m = toxicity.fitted(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), SMALL)

    def word(w):
        w = w.strip(toxicity.MARKS)
        grams = [f"<{w}>"] + [f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
        return sum(m.weight[zlib.crc32(g.encode()) % SMALL.buckets] for g in grams) / len(grams)

    def plain(text):
        words = []
        for w in (text or "").lower().split():
            w = w.strip(toxicity.MARKS) if len(w) > 64 else w
            words += [w[i : i + 64] for i in range(0, len(w) - 5, 59)] if len(w) > 64 else [w]
        per = [word(w) for w in words]
        per = [x for i, x in enumerate(per) if not i or x != per[i - 1]]
        worst = max((sum(per[i : i + 8]) for i in range(max(1, len(per) - 7))), default=0.0)
        return 1 / (1 + np.exp(-(worst / 8 + m.bias)))

    data = spark.sparkContext.broadcast(m)
    got = toxicity._scores(toxicity.pa.array([t for _, t in docs]), "plain", data)
    assert np.allclose(got, [plain(t) for _, t in docs], atol=1e-9)
    assert got[-4] != got[-3]
