import corpus_pipeline
from lumenary.llm import decontaminate, neardup, quality, toxicity
from lumenary.llm.common import drop_rows, keep_rows, stored

from .brute import near_duplicates
from .conftest import SF


def test_each_stage_takes_effect_on_all_that_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near-duplicates", "benchmark decontamination", "best-fit packing"]

    one = stored(stage[names[0]](spark, docs, SF), "t")
    assert one.columns == columns and ids(one) == sorted(r.doc_id for r in quality.verdicts(docs).filter("kept").collect())
    two = stored(stage[names[1]](spark, one, SF), "t")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert two.columns == columns and ids(two) == sorted(r.doc_id for r in toxicity.scored(one, labels).filter("predicted = 0").collect())
    three = stored(stage[names[2]](spark, two, SF), "t")
    want = near_duplicates([(r.doc_id, r.text) for r in two.collect()], 5, 80)
    assert three.columns == columns and ids(three) == sorted(d for d, (_, c) in want.items() if d == c)
    four = stored(stage[names[3]](spark, three, SF), "t")
    leaking = {r.doc_id for r in decontaminate.leaks(three, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaking and four.columns == columns and ids(four) == [d for d in ids(three) if d not in leaking]
    five = stage[names[4]](spark, four, SF).collect()
    assert {r.doc_id for r in five} == set(ids(four))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_rows_are_kept_with_odd_columns(docs_of, spark):
    docs = docs_of([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, None), (3, "d")])
    good = docs.selectExpr("doc_id", "xxhash64(doc_id, text, source) AS row_key").filter("doc_id IS NULL OR doc_id < 3").join(spark.createDataFrame([("x",)], "z string"))
    kept = keep_rows(docs, good)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "1", "2", "None"]
    assert keep_rows(docs, good, once=True).count() == 4 and [r.doc_id for r in drop_rows(docs, good).collect()] == [3]


def test_one_of_each_group_of_repeated_rows_stays(docs_of, spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = docs_of([(1, text), (1, text), (2, text + " more"), (3, "other words that are not like it at all"), (4, None), (5, "")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3, 4, 5]
    assert neardup.near_duplicates(docs).count() == 6


def test_unlike_documents_without_or_with_one_id_all_stay(docs_of, spark):
    text = lambda k, more="": " ".join(f"{k}w{i}" for i in range(40)) + more
    docs = docs_of([(None, text("a")), (None, text("b")), (None, text("b", " more")), (None, text("c")), (7, text("d")), (7, text("e")), (7, text("e")), (8, text("c"))])
    got = sorted((str(r.doc_id), r.text[0]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == [("7", "d"), ("7", "e"), ("8", "c"), ("None", "a"), ("None", "b")]
