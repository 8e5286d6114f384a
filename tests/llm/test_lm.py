import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenary.llm import attention as a
from lumenary.llm import lm
from lumenary.llm.registry import op10_lm_scores
from lumenary.llm.tokens import ranked, vocabulary

from .brute import FOLD, WORDS

TINY = a.Shape(slots=128, dim=8, heads=2, hidden=16, stride=4)
SMALL = lm.Settings(shape=a.Shape(slots=256, dim=16, heads=2, hidden=32, stride=8), least_tokens=400_000, rounds=2, passes=4)


def naive(p, s, tokens):
    """Log-probability of a text, token by token: full softmaxes, windows as described."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    seq, total, dh = [0] * (s.stride + 1) + list(tokens), 0.0, s.dim // s.heads
    for i, target in enumerate([*tokens, 0]):
        at = s.stride + i
        first = (i // s.stride) * s.stride
        e = p["emb"][seq[first : at + 1]].astype(float)
        q, k, v = e[-1] @ p["q"], e @ p["k"], e @ p["v"]
        z = []
        for h in range(s.heads):
            c = slice(h * dh, h * dh + dh)
            w = soft(k[:, c] @ q[c] / dh**0.5 + p["dist"][h, len(e) - 1 - np.arange(len(e))])
            z.append(w @ v[:, c])
        u = np.clip(e[-1] @ p["own"] + np.concatenate(z) @ p["seen"] + p["bias"], 0, a.MOST)
        u[-1] = 1
        c = target // a.WIDTH
        total += np.log(soft(u @ p["cls"])[c]) + np.log(soft(u @ p["tok"][c])[target % a.WIDTH])
    return total


@pytest.fixture(scope="module")
def params():
    rng = np.random.default_rng(3)
    p = a.initial(rng.integers(0, 50, TINY.slots), TINY, 2)
    for k in p:
        p[k] = (p[k] + rng.normal(0, 0.2, p[k].shape)).astype(np.float32)
    return p


def test_windows_score_each_token_once(params):
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 3, 4, 5, 8, 30, 0, 17])
    flat = rng.integers(1, TINY.slots, lengths.sum())
    got = a.Scorer(params, TINY).texts(flat, lengths)
    at = np.concatenate(([0], np.cumsum(lengths)))
    want = [naive(params, TINY, flat[at[i] : at[i + 1]]) for i in range(len(lengths))]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_lots_and_large_logits_do_not_matter(params, monkeypatch):
    flat, lengths = np.random.default_rng(1).integers(1, TINY.slots, 100), np.array([60, 40])
    one = a.Scorer(params, TINY).texts(flat, lengths)
    monkeypatch.setattr(a.Scorer, "LOT", 3)
    assert np.allclose(a.Scorer(params, TINY).texts(flat, lengths), one, rtol=1e-5)
    big = {k: v * (8 if k in ("q", "k", "cls", "tok") else 1) for k, v in params.items()}
    sc = a.Scorer(big, TINY)
    assert not any(sc.bounded) and np.isfinite(sc.texts(flat, lengths)).all()


def test_probabilities_of_the_next_token_add_up_to_one(params):
    s, n = a.Scorer(params, TINY), TINY.slots
    x = np.tile(np.array([[5, 9, 1, 3]], np.int32), (n, 1))
    target = np.tile(np.arange(n, dtype=np.int32)[:, None], (1, 4))
    p = np.exp(s.tokens(x, np.zeros_like(x), target).reshape(n, 4)).sum(0)
    assert np.allclose(p, 1, atol=1e-4)
    sl = lm.Slots.of(np.arange(1000.0)[::-1].copy(), 10, TINY)
    assert abs(np.exp(sl.rare[sl.slot == a.RARE]).sum() - 1) < 1e-9


def test_gradients(params):
    p = {k: v.astype(float) for k, v in params.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, TINY.slots, (3, 8)), rng.integers(0, TINY.slots, (3, 8))
    y[1, 5:] = -1
    g = a.gradients(p, x, y, TINY)[1]
    for k in p:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in p[k].shape)
            i = (x[0, 3], *i[1:]) if k == "emb" else i
            old, d = p[k][i], []
            for step in (1e-5, -1e-5):
                p[k][i] = old + step
                d.append(a.gradients(p, x, y, TINY)[0])
            p[k][i] = old
            assert abs((d[0] - d[1]) / 2e-5 - g[k][i]) < 1e-5


def test_spelling_is_whole_and_by_word():
    of = ranked(vocabulary("byte_bpe_multi_50k.tiktoken"))
    words = ["the", "Étude", "日本語", "a b", " ", "　x ", "'s", "...!", "\U0001f600", "z" * 500]
    ids, n = lm.spelt([w.encode() for w in words], of)
    ends = np.cumsum(n)
    assert [of.decode(ids[e - k : e].tolist()) for e, k in zip(ends, n, strict=True)] == [" " + w for w in words]


def corpus(n=300):
    rng = random.Random(6)
    parts = ["tion", "er", "an", "ing", "the", "re", "on", "it", "es", "le"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 150)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, " \n\x0b "), (903, "Unseen " + "q" * 3000), (904, "ÉTÉ été THE the"), (905, "same words"), (905, "same words"), (None, "no id the"), (906, "the er " * 20_000)]
    return rows


@pytest.fixture(scope="module")
def scored(docs_of):
    rows = corpus()
    return rows, lm.scored(docs_of(rows), SMALL).collect()


def test_base_is_that_of_the_description(scored):
    rows, got = scored
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter()
    for d, t in rows:
        if not out(d):
            c.update(WORDS.findall((t or "").translate(FOLD)))
            c[None] += 1
    n, v, want = sum(c.values()), len(c), []
    for d, t in rows:
        w = [*WORDS.findall((t or "").translate(FOLD)), None]
        want.append((str(d), out(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)


def test_the_model_predicts_held_out_texts(scored):
    rows, got = scored
    out = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(out) > 30 and sum(r.score for r in out) > sum(r.base_score for r in out)
    by = {r.doc_id: r for r in got}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got) and by[900].score == by[901].score == by[902].score


def test_words_beyond_the_broadcast_are_joined(docs_of, scored, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    rows, got = scored
    tiny = lm.Settings(shape=SMALL.shape, least_tokens=1000, rounds=1, passes=1)
    again = lm.scored(docs_of(rows), tiny).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_worker_forgets_no_count(monkeypatch):
    monkeypatch.setattr(lm, "MEMO", 20)
    counts = np.zeros(ranked(vocabulary("byte_bpe_multi_50k.tiktoken")).n_vocab)
    m = lm.Model(a.initial(np.ones(TINY.slots), TINY), TINY, lm.Slots.of(counts, 1, TINY), vocabulary("byte_bpe_multi_50k.tiktoken"), [b"x1", b"x2"], np.array([5, 3]), 8, 2, 1)
    texts = [" ".join(f"x{i}" for i in range(k, k + 30)).encode() for k in range(0, 90, 10)]
    w = lm.Worker(m)
    many = [w.scores([t]) for t in texts]
    one = lm.Worker(m).scores(texts)
    assert np.allclose(np.concatenate([x["score"] for x in many]), one["score"]) and np.allclose(np.concatenate([x["base"] for x in many]), one["base"])


def test_nothing_to_learn_from_and_no_rows(docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    tiny = lm.Settings(shape=TINY, least_tokens=1000, rounds=1, passes=1)
    (r,) = lm.scored(docs_of([(held, "a b")]), tiny).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score) and abs(r.base_score) < 1e-9
    assert lm.scored(docs_of([(1, "a")]).limit(0), tiny).count() == 0


def test_query_columns():
    assert op10_lm_scores.__doc__


def test_all_training_ids_are_learnt_from_once_at_every_size(monkeypatch):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    of, s = ranked(path), lm.Settings(shape=TINY)
    slots = lm.Slots.of(np.ones(of.n_vocab), 1, TINY)
    sent = type("Sent", (), {"value": slots})
    texts = ["", None, "a", "tion " * 3000, *(f"some words{i} of a longer text {'x' * i} " * (i % 40) for i in range(200))]
    monkeypatch.setattr(lm, "LOT_WINDOWS", 100)
    got = Counter()
    for b in lm._windows([pa.RecordBatch.from_pydict({"text": texts})], path, sent, s):
        for w in b.column("window").to_pylist():
            row = np.frombuffer(w, "<u2")
            assert len(row) == TINY.window + 1
            got.update(row[1:][row[1:] != lm.PAD].tolist())
    want = Counter()
    for t in texts:
        want.update([*slots.slot[lm.spelt([w.encode() for w in (t or "").split()], of)[0]].tolist(), a.END])
    assert got == want
    assert lm.Settings().least_tokens == 0  # so one pass, whatever the size


def test_windows_keep_beginnings_and_ends_whole():
    for n in (0, 1, 14, 15, 16, 33, 50, 200):
        ids = np.arange(2, 2 + n)
        rows = lm.windows_of(ids, a.Shape())
        told = [(x, y) for r in rows for x, y in zip(r[:-1].tolist(), r[1:].tolist(), strict=True) if y != lm.PAD]
        assert told == list(zip([lm.PAD, *ids.tolist()], [*ids.tolist(), a.END], strict=True))
        assert (rows[0][: a.Shape().stride + 1] == lm.PAD).all()


def test_windows_of_stored_slots_are_those_of_texts(monkeypatch):
    """Texts are read once: learning takes the slots that reading leaves, many windows in a row."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    of, s = ranked(path), lm.Settings(shape=TINY)
    rng = np.random.default_rng(2)
    slots = lm.Slots.of(rng.integers(0, 50, of.n_vocab).astype(float), 1, TINY)
    sent = type("Sent", (), {"value": slots})
    texts = [b"", b" \x0b a  B\r\nc ", "É é\xa0x THE ".encode(), b"tion " * 3000, *(f"some words{i} {'x' * i} ".encode() * (i % 9) for i in range(60))]
    w = lm.Worker(lm.Model(None, TINY, slots, path, [b"a", b"the"], np.array([5, 3]), 8, 2, 1))
    x = w.read(texts)
    ends = np.cumsum(x["sizes"])
    read = pa.RecordBatch.from_pydict({"slots": [x["slots"][e - n : e].astype("<u2").tobytes() for e, n in zip(ends, x["sizes"], strict=True)]})
    monkeypatch.setattr(lm, "LOT_WINDOWS", 100)
    monkeypatch.setattr(lm, "ROW_WINDOWS", 7)
    size = 2 * (TINY.window + 1)
    got, rounds = Counter(), set()
    for b in lm._window_rows([read], path, sent, s):
        for r, n, data in zip(*(b.column(c).to_pylist() for c in ("round", "n", "windows")), strict=True):
            assert 1 <= n <= 7 and len(data) == n * size
            rounds.add(r)
            got.update(data[i : i + size] for i in range(0, len(data), size))
    want = Counter()
    for b in lm._windows([pa.RecordBatch.from_pydict({"text": [t.decode() for t in texts]})], path, sent, s):
        want.update(b.column("window").to_pylist())
    assert got == want and rounds == set(range(s.rounds))
    assert x["n_tokens"].tolist() == [len(t.split()) + 1 for t in texts]
    assert x["others"].to_pylist() == [[v for v in t.lower().split() if v not in (b"a", b"the")] for t in texts]


def test_words_are_those_of_the_description():
    texts = ["", None, " \x0b\x0ca  b\r\n\x1cC\x85d ", "É É\xa0x A", "\x00 A", "a\tB"]
    want = [WORDS.findall((t or "").translate(FOLD)) for t in texts]
    for lo, hi in ((0, 6), (2, 4), (0, 2)):
        words, codes, n = lm.words_of(pa.array(texts).slice(lo, hi - lo))
        assert n.tolist() == [*map(len, want[lo:hi])]
        assert [words[c].decode() for c in codes] == [w for p in want[lo:hi] for w in p]


def test_large_attention_does_not_overflow_in_learning(params):
    p = {k: v * (30 if k in ("q", "k") else 1) for k, v in params.items()}
    rng = np.random.default_rng(0)
    loss, g = a.gradients(p, rng.integers(0, TINY.slots, (3, 8)), rng.integers(0, TINY.slots, (3, 8)), TINY)
    assert math.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())
    none = a.gradients(p, np.zeros((2, 8), int), np.full((2, 8), -1), TINY)
    assert none[0] == 0 and not any(x.any() for x in none[1].values())


def test_words_left_to_join_are_passed_on_once_a_text():
    lists = pa.array([[b"b", b"a", b"b"], [], [b"a"], [b"c", b"c", b"c"]], pa.list_(pa.binary())).slice(0, 4)
    words, times = lm._distinct(lists)
    assert [dict(zip(w, n, strict=True)) for w, n in zip(words.to_pylist(), times.to_pylist(), strict=True)] == [{b"a": 1, b"b": 2}, {}, {b"a": 1}, {b"c": 3}]
    assert [len(x) for x in words.to_pylist()] == [2, 0, 1, 1] and lm._distinct(lists.slice(1, 1))[0].to_pylist() == [[]]


def test_counting_sums_what_it_holds(monkeypatch):
    """A task passes on a row a word, not one a batch, until it holds more words than it may."""
    texts = [None, "", " \x0b", *(" ".join(f"W{j % 9} w{j % 7} é" for j in range(i)) for i in range(40))]
    want = Counter(w.encode() for t in texts for w in WORDS.findall((t or "").translate(FOLD)))
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 5], pa.string())}) for i in range(0, len(texts), 5)]
    for most in (400_000, 3):
        monkeypatch.setattr(lm, "HELD", most)
        rows, got = 0, Counter()
        for b in lm._counted(iter(batches)):
            rows += len(b)
            for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True):
                got[w] += n
        assert got == want and (rows == len(want) or most == 3)
    assert list(lm._counted(iter([]))) == []


def test_steps_run_as_one_graph(params, monkeypatch):
    """A step's products and sums are one call, in single and double precision alike, whatever the classes."""
    rng = np.random.default_rng(4)
    for s in (TINY, a.Shape(slots=2048, dim=8, heads=1, hidden=16, stride=4)):
        p = params if s is TINY else a.initial(rng.integers(1, 50, s.slots), s)
        x, y = rng.integers(0, s.slots, (5, 8)), rng.integers(0, s.slots, (5, 8))
        y[2, 3:] = -1
        calls, real = [], a._learning
        with monkeypatch.context() as m:
            m.setattr(a, "_learning", lambda *z: calls.append(z) or real(*z))  # noqa: B023
            loss, g = a.gradients(p, x, y, s)
        exact, want = a.gradients({k: v.astype(float) for k, v in p.items()}, x, y, s)
        assert len(calls) == 1 and abs(loss - exact) < 1e-4 and g.keys() == want.keys() == p.keys()
        assert all(g[k].dtype == np.float32 and g[k].shape == p[k].shape and np.allclose(g[k], want[k], atol=1e-5, rtol=1e-3) for k in p)
