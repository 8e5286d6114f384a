import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from lumenary.llm import packing
from lumenary.llm.registry import op6_best_fit_packing
from lumenary.llm.tokens import vocabulary

from .conftest import SF


def ids_of(text):
    own = Tokenizer.from_file(vocabulary())
    return [*own.encode(text or "", add_special_tokens=False).ids, 0]


def checked(rows, got, seq_len):
    """Pieces hold the texts' ids, and lie without gaps in sequences."""
    want = []
    for d, t in rows:
        ids = np.array(ids_of(t), "<u4")
        want += [(str(d), k, at, min(seq_len, len(ids) - at), zlib.crc32(ids[at : at + seq_len].tobytes())) for k, at in enumerate(range(0, len(ids), seq_len))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(by), sum(w[3] for w in want)


def test_round_trip_and_few_sequences(docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "of", "reading", "xylophones", "née", "A.B", "日本"], k=rng.randint(0, 400)))) for i in range(500)]
    rows += [(600, None), (601, ""), (602, " \n "), (603, "tokens, " * 9000), (604, "z" * 4000), (605, "same"), (605, "same"), (None, "no id\nat all")]
    n, tokens = checked(rows, packing.packed_pieces(docs_of(rows, 6), 256).collect(), 256)
    assert n <= -(-tokens // 256) * 1.02 + 1


def test_smallest_table(spark, sample):
    n, tokens = checked([(d, t) for d, t, _ in sample], op6_best_fit_packing(spark, SF).collect(), 2048)
    assert n <= -(-tokens // 2048) * 1.02 + 1


def test_best_fit_takes_the_fullest_bin_that_has_room():
    rng = random.Random(2)
    for _ in range(30):
        sizes, room = [rng.randint(1, 40) for _ in range(rng.randint(0, 120))], 64
        left, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [b for b in range(len(left)) if left[b] >= sizes[i]]
            if fit:
                b = min(left[b] for b in fit)
                b = next(k for k in reversed(range(len(left))) if left[k] == b and k in fit)
            else:
                b = len(left)
                left.append(room)
                want.append([])
            left[b] -= sizes[i]
            want[b].append(i)
        got = packing.best_fit(sizes, room)
        assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(sum(sizes[i] for i in b) for b in want)
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))


def test_ids_are_kept_where_asked_for(docs_of):
    rows = packing.pack(docs_of([(1, "some words here"), (2, "more")]), 64, keep_ids=True).collect()
    got = {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for r in rows for x in r["items"]}
    assert got == {1: ids_of("some words here"), 2: ids_of("more")}


def test_empty_table(docs_of):
    assert packing.packed_pieces(docs_of([(1, "a")]).limit(0)).count() == 0


def test_parts_merge_up_a_tree(docs_of, monkeypatch):
    """Many parts of few items each: what two rounds leave is merged on until one part is left."""
    monkeypatch.setattr(packing, "MERGED", 24)
    docs = docs_of([(i, " ".join(["word"] * (5 + i * 7 % 23))) for i in range(900)], 60)
    got = packing.pack(docs, seq_len=100).collect()
    assert sorted(x.doc_id for r in got for x in r["items"]) == list(range(900)) and all(r.fill == sum(x.length for x in r["items"]) <= 100 for r in got)
    assert len(got) <= 1.06 * sum(r.fill for r in got) / 100
    assert max(r.sequence_id >> 56 for r in got) > 2


def test_sequences_that_never_fit_together_end_the_rounds(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 10)
    docs = docs_of([(i, " ".join(["word"] * 60)) for i in range(50)], 8)
    assert len(packing.pack(docs, seq_len=100).collect()) == 50
