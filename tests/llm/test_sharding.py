import hashlib

from pyspark.sql import functions as F

from lumenary.llm import sharding
from lumenary.llm.registry import QUERIES

from .conftest import SF, sorted_rows


def brute(rows, limit):
    """Split bucket by bucket, as the directory does."""
    md5 = lambda b: hashlib.md5(b).hexdigest()
    keyed = []
    for r in rows:
        inner = "null" if r[1] is None else md5(r[1].encode())
        h = int(md5(f"{'null' if r[0] is None else r[0]}:{inner}".encode())[:15], 16)
        keyed.append((r[0], len((r[1] or "").encode()), format(h, "060b")))
    out, todo = [], [("", keyed)] if keyed else []
    while todo:
        prefix, rows = todo.pop()
        size = sum(n for _, n, _ in rows)
        if size <= limit or len(prefix) == 60:
            out += [(len(prefix), str(d), n, size > limit, prefix) for d, n, _ in rows]
        else:
            todo += [(prefix + b, part) for b in "01" if (part := [x for x in rows if x[2][len(prefix)] == b])]
    return sorted(out)


def test_shards_are_those_of_splitting(docs_of):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(600)] + [(700, None), (701, ""), (702, "y" * 50_000), (703, "same" * 100), (703, "same" * 100), (None, "no id")]
    for limit in (1_000_000, 20_000, 3_000):
        got = sorted((r.depth, str(r.doc_id), r.n_bytes, r.oversized, r.shard) for r in sharding.shard_documents(docs_of(rows), limit).collect())
        assert got == brute(rows, limit)


def test_every_shard_fits_but_one_row(docs_of):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(600)] + [(702, "y" * 50_000)]
    out = sharding.shard_documents(docs_of(rows), 3_000)
    by = out.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.max("oversized").alias("o"), F.count("*").alias("n")).collect()
    assert all(r.b <= 3_000 or (r.o and r.n == 1) for r in by) and sum(r.o for r in by) == 1


def test_written_shards_hold_their_rows(docs_of, spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(300)]
    said = {r.doc_id: r.shard for r in sharding.write_shards(docs_of(rows).select("doc_id", "text"), 20_000, f"{tmp_path}/s").collect()}
    got = spark.read.schema("doc_id long, text string, shard string").parquet(f"{tmp_path}/s").collect()
    assert {r.doc_id: r.shard for r in got} == said and {r.doc_id: r.text for r in got} == dict(rows)


def test_sql_twin(spark, oracle, docs_of):
    assert sorted_rows(QUERIES["op9_extendible_sharding"](spark, SF)) == oracle(sharding.SQL)


def test_empty_table(docs_of):
    assert sharding.shard_documents(docs_of([(1, "a")]).limit(0), 10).count() == 0


def test_query_writes_every_document_to_its_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "LIMIT_BYTES", 20_000)
    monkeypatch.setattr(sharding, "output_folder", lambda _: f"{tmp_path}/q")
    said = sorted((r.doc_id, r.shard) for r in QUERIES["op9_extendible_sharding"](spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = spark.read.schema("doc_id long, text string, shard string").parquet(f"{tmp_path}/q").collect()
    assert len({s for _, s in said}) > 1 and sorted((r.doc_id, r.shard) for r in got) == said
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_written_assignment_is_that_of_the_rows(docs_of, tmp_path):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(100)] + [(700, None), (703, "same"), (703, "same"), (None, "no id")]
    for limit in (1_000_000, 3_000):
        got = sharding.write_shards(docs_of(rows).select("doc_id", "text"), limit, f"{tmp_path}/{limit}").collect()
        assert sorted((r.depth, str(r.doc_id), r.n_bytes, r.oversized, r.shard) for r in got) == brute(rows, limit)
    assert sharding.write_shards(docs_of(rows).select("doc_id", "text").limit(0), 10, f"{tmp_path}/none").count() == 0
