from lumenary.llm import counts
from lumenary.llm.tokens import vocabulary

from .brute import WORDS


def fewest(word, own):
    """Tokens of the best segmentation of one word, without a trie."""
    text = counts.BEGIN + word
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        n = len(text[i - 1].encode("utf-8", "surrogatepass"))
        score, tokens = best[i - 1][0] + n * own.byte, best[i - 1][1] + n
        for j in range(max(0, i - own.longest), i):
            s = own.score.get(text[j:i])
            if s is not None:
                s += best[j][0]
                if s > score or s == score and best[j][1] + 1 < tokens:
                    score, tokens = s, best[j][1] + 1
        best.append((score, tokens))
    return best[-1][1]


def test_counts_are_those_of_each_word_alone(docs_of, sample):
    own = counts.pieces(vocabulary("piece_bpe_32k.model"))
    odd = [(900, None), (901, ""), (902, " \n\t "), (903, "日本語 \U0001f600\U0001f600 ünïcödé x y"), (904, "z" * 5000), (905, "same same"), (905, "same same"), (None, "no id")]
    data = [(d, t) for d, t, _ in sample] + odd
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in counts.token_counts(docs_of(data)).collect())
    memo = {}
    want = []
    for d, t in data:
        w = WORDS.findall(t or "")
        want.append((str(d), len(w), sum(memo.setdefault(x, fewest(x, own)) for x in w)))
    assert got == sorted(want)


def test_shared_prefixes_are_scored_once(monkeypatch):
    own = counts.pieces(vocabulary("piece_bpe_32k.model"))
    made = []
    node = counts.Node
    monkeypatch.setattr(counts, "Node", lambda *a: made.append(1) or node(*a))
    counts.trie_counts(["trains", "training", "trained", "train"], own)
    assert len(made) == 1 + len({(counts.BEGIN + w)[:i] for w in ("trains", "training", "trained") for i in range(1, len(w) + 2)})


def test_small_bounds_do_not_change_counts(docs_of, monkeypatch):
    own = counts.Counts(vocabulary("piece_bpe_32k.model"))
    words = {f"word{i}" for i in range(50)}
    whole = own.learn(words)
    monkeypatch.setattr(counts, "MEMO", 10)
    less = counts.Counts(vocabulary("piece_bpe_32k.model"))
    assert {w: n for part in (sorted(words)[:25], sorted(words)[25:]) for w, n in less.learn(set(part)).items()} == whole


def test_empty_table(docs_of):
    assert counts.token_counts(docs_of([(1, "a")]).limit(0)).count() == 0
