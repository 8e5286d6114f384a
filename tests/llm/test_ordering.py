import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenary.llm import ordering
from lumenary.llm.registry import op8_token_shards
from lumenary.llm.tokens import vocabulary

from .conftest import SF


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 65_537])
def test_slots_are_a_permutation_that_the_key_selects(n):
    a, b = ordering.feistel(np.arange(n), n, 1), ordering.feistel(np.arange(n), n, 2)
    assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
    assert n < 16 or (a != b).any() and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.9
    part = np.arange(n)[n // 2 :]
    assert (ordering.feistel(part, n, 1) == a[n // 2 :]).all()  # a part alone gets the same slots


def test_round_trip(docs_of, tmp_path):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(200)] + [(300, None), (301, ""), (302, "long " * 20_000), (303, "same"), (303, "same"), (None, "no id")]
    at = f"file://{tmp_path}/out"
    manifest = sorted(ordering.materialise(docs_of(rows, 5), at, seq_len=128, per_shard=50).collect())
    n = len(manifest)
    assert [r.slot for r in manifest] == list(range(n)) and all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 256 for r in manifest)
    seqs = [*ordering.read_sequences(at)]
    assert len(seqs) == n and all(zlib.crc32(s[: r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32 and not s[r.n_tokens :].any() for s, r in zip(seqs, manifest, strict=True))
    own = Tokenizer.from_file(vocabulary())
    whole = sorted(tuple(own.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    # Undo the permutation: the parts' streams, cut at the end ids, are the texts.
    slots = ordering.feistel(np.arange(n), n, 42)
    stream = np.concatenate([seqs[s][: manifest[s].n_tokens] for s in slots])
    ends = np.flatnonzero(stream == 0)
    cuts = np.split(stream, ends + 1)[:-1]
    assert sorted(tuple(c[:-1].tolist()) for c in cuts) == whole
    assert {d for r in manifest for d in r.doc_ids} == {d for d, _ in rows}


def test_reading_resumes_anywhere(docs_of, tmp_path):
    at = f"file://{tmp_path}/out"
    ordering.materialise(docs_of([(i, "words and words " * 30) for i in range(60)]), at, seq_len=64, per_shard=7)
    all_ = [s.tolist() for s in ordering.read_sequences(at)]
    assert [s.tolist() for s in ordering.read_sequences(at, 9, 23)] == all_[9:23]


def test_written_again_it_is_the_same(docs_of, tmp_path):
    docs = docs_of([(i, f"{i} words " * 20) for i in range(50)]).coalesce(1).sortWithinPartitions("doc_id")
    for k in "ab":
        ordering.materialise(docs, f"file://{tmp_path}/{k}", seq_len=32, per_shard=8)
    names = sorted(p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith("."))
    assert all((tmp_path / "a" / x).read_bytes() == (tmp_path / "b" / x).read_bytes() for x in names) and "index.json" in names


def test_empty_table(docs_of, tmp_path):
    assert ordering.materialise(docs_of([(1, "a")]).limit(0), f"file://{tmp_path}/e").count() == 0
    assert json.loads((tmp_path / "e" / "index.json").read_text())["n"] == 0


def test_query(spark):
    assert op8_token_shards(spark, SF).columns == ["slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids"]


def test_large_vocabularies_take_wider_ids(docs_of, tmp_path):
    import json

    from lumenary.llm.tokens import vocabulary

    with open(vocabulary(), encoding="utf-8") as f:
        model = json.load(f)
    n = len(model["model"]["vocab"])
    model["added_tokens"] += [{"id": n + 100 + i, "content": f"[extra{i}]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False} for i in range(70_000)]
    with open(f"{tmp_path}/wide.json", "w", encoding="utf-8") as f:
        json.dump(model, f)
    docs = docs_of([(1, "some words [extra69999] here"), (2, "more words")], 1)
    ordering.materialise(docs, f"file://{tmp_path}/out", seq_len=4, path=f"{tmp_path}/wide.json").count()
    got = [x.tolist() for x in ordering.read_sequences(f"file://{tmp_path}/out")]
    assert max(map(max, got)) >= 1 << 16


def test_parts_are_numbered_without_gaps(docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(ordering, "GROUP", 3)
    monkeypatch.setattr(ordering, "BROADCAST_PARTS", 0)
    out = ordering.materialise(docs_of([(i, f"text number {i} " * 5) for i in range(80)], 11), f"file://{tmp_path}/out", seq_len=16, per_shard=8)
    slots = sorted(r.slot for r in out.collect())
    assert slots == list(range(len(slots))) and len(slots) > 11


def test_ids_of_pieces_are_the_tokenizers():
    """Parts below U+0100 are cut without the tokenizer, and their ids are its."""
    import random

    from lumenary.llm.tokens import IdBytes

    of, own, whole = IdBytes(vocabulary()), Tokenizer.from_file(vocabulary()), []
    of.encoded = lambda part: whole.append(part) or IdBytes.encoded(of, part)
    rng, some = random.Random(8), "".join(map(chr, range(0x21, 0x180))) + "'''stremdvl   \n\t\x1ćK"
    texts = ["".join(rng.choices(some, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += [f"{x}{c}{y}" for c in map(chr, range(0x21, 0x180)) for x, y in (("", ""), ("X", "."), ("a'", "s"))]
    texts += ["<|endoftext|>", "(<|ENDOFTEXT|>)", "it's 'Tis WE'LL x''s", "CHHEITÜ!!", "(Word); (word), 12:30 ¼x²"]
    for t in texts:
        assert np.frombuffer(of.text(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)
    whole.clear()
    of.text("New(Word); it's Unlike,ly 'tis CHHEITÜXQ!! 17:45")
    assert not whole
