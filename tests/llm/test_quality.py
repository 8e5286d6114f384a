from collections import Counter

import corpus_pipeline
from lumenary.llm import quality
from lumenary.llm.registry import QUERIES

from .brute import WORDS
from .conftest import SF, sorted_rows

LINE = "every page of this host has this very line at its end as it seems to be"


def rows():
    body = " ".join(f"w{i}" for i in range(60))
    out = [(i, f"{body} number {i}\n{LINE}", "hot") for i in range(40)]
    boiler = "\n".join(" ".join(f"b{k}x{j}" for j in range(12)) for k in range(6))
    out += [(400 + i, f"{boiler}\nown{i} words", "hot") for i in range(30)]
    out += [(100 + i, f"{LINE}\n{LINE}\n{LINE}\n{LINE} {i}", "hot") for i in range(3)]  # four copies of one line, nearly
    out += [(200 + i, f"{LINE}\n" * 6 + f"own {i}", "hot") for i in range(3)]
    out += [(300, None, "hot"), (301, "", None), (302, " \n\t\r\x0b\x0c ", "cold"), (303, "a b c a b c a b c " * 30, "cold"), (304, "#*$%&|<> " * 60, "cold"), (305, "É" * 70_000 + " b" * 60, "cold"), (None, body, None)]
    out += [(306, "one two " * 60 + "\n\nx y\nx y\n x y", "cold")] * 2
    return out


def brute(data, limits=quality.Limits()):
    """The rules from their description."""
    hosts, lines, result = {}, {}, []
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    norm = lambda x: fold(" ".join(WORDS.findall(x)))
    for _, t, s in data:
        hosts.setdefault(s, set()).add(t or "")
    for s, texts in hosts.items():
        lines[s] = Counter(x for t in texts for x in {norm(y) for y in t.split("\n") if WORDS.search(y)})
    for d, t, s in data:
        t = t or ""
        w = WORDS.findall(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        real = [x for x in t.split("\n") if WORDS.search(x)]
        frequent = {x for x, n in lines[s].items() if n > limits.min_docs and n * 100 > len(hosts[s]) * limits.percent}
        removed = sum(len(WORDS.findall(x)) for x in real if norm(x) in frequent)
        failed = len(w) < limits.min_words or 100 * len(again) > limits.repeat_percent * len(w)
        kept = not failed and (len(w) - removed) * 100 >= len(w) * limits.left_percent
        result.append((failed, d, kept, len(real) - len(set(real)), len(again), sum(c in "#*$%&|<>" for c in t), len(w), removed, sum(map(len, w))))
    key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
    return sorted(result, key=key)


def test_counts_and_verdicts_are_those_of_the_description(docs_of):
    data = rows()
    assert sorted_rows(quality.verdicts(docs_of(data, 7)).drop("row_key")) == brute(data)


def test_frequent_lines_are_removed_and_depleted_documents_rejected(docs_of):
    got = {r.doc_id: r for r in quality.verdicts(docs_of(rows())).collect()}
    assert got[0].removed_words == len(LINE.split()) and got[0].kept
    assert got[400].removed_words == 72 and not got[400].base_failed and not got[400].kept
    assert got[200].base_failed and not got[200].kept
    assert not got[300].kept and got[300].n_words == 0


def test_sql_twin(oracle, docs_of, spark):
    data = [r for r in rows() if r[0] is not None]
    assert sorted_rows(quality.verdicts(docs_of(data)).drop("row_key")) == oracle(quality.SQL, data)
    assert sorted_rows(QUERIES["op4_quality_rules"](spark, SF)) == oracle(quality.SQL)


def test_empty_table(docs_of):
    assert quality.verdicts(docs_of([(1, "a")]).limit(0)).count() == 0


def test_cleaned_gives_kept_rows_without_their_frequent_lines(docs_of, spark):
    data = rows() + [(500, f"{LINE}\n\n" + " ".join(f"É{i}" for i in range(60)) + f"\n  {LINE.upper()}  \nlast", "hot")] * 2
    docs = docs_of(data)
    out = quality.cleaned(docs)
    kept = sorted(str(r.doc_id) for r in quality.verdicts(docs).filter("kept").collect())
    got = out.collect()
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in got) == kept
    texts = {r.doc_id: r.text for r in got}
    body = " ".join(f"w{i}" for i in range(60))
    assert all(texts[i] == f"{body} number {i}" for i in range(40))
    assert texts[500] == "\n" + " ".join(f"É{i}" for i in range(60)) + "\nlast"
    stage = dict(corpus_pipeline.STAGES)["quality rules"](spark, docs, SF)
    assert sorted((str(r.doc_id), r.text) for r in stage.collect()) == sorted((str(r.doc_id), r.text) for r in got)


def test_limit_does_not_grow_with_the_host(docs_of):
    rng = "abcdefghijklmnopqrst"
    words = lambda i: " ".join(f"{rng[i % 20]}{i}x{j}" for j in range(60))
    data = [(i, f"{words(i)}\n{LINE}" if i < 21 else words(i), "hot") for i in range(400)]
    assert {r.doc_id for r in quality.verdicts(docs_of(data)).collect() if r.removed_words} == set(range(21))
    assert not [r for r in quality.verdicts(docs_of(data[1:])).collect() if r.removed_words]


def test_many_frequent_lines_are_joined_with_salt(docs_of, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert sorted_rows(quality.verdicts(docs_of(rows(), 7)).drop("row_key")) == brute(rows())
