"""Catalogs of indexes."""

import pytest
from pyspark.sql import types as T

from lumenary.functions.values import RequestError
from lumenary.operators import retrievers
from lumenary.plans.index import Index
from lumenary.sources.catalog import Catalog

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"{tmp_path}/tenant")


def rows(spark, data):
    return spark.createDataFrame(data, "id string, a long, text string")


def test_life_of_an_index(spark, catalog):
    assert catalog.list() == []
    s = catalog.create("docs", SCHEMA, text={"text": {"remove_stopwords": True}})
    s.write(1, upserts=rows(spark, [("x", 1, "the one"), ("y", 2, "a two")]))
    catalog.create("other", SCHEMA)
    assert catalog.list() == ["docs", "other"] and catalog.list("do") == ["docs"] and catalog.list(cursor="docs", page_size=1) == ["other"]
    assert catalog.summary("docs") | {"schema": ""} == {"name": "docs", "rows": 2, "epoch": 1, "schema": "", "pending": 0, "read_only": False}
    assert catalog.analyzers("docs")["text"].terms("the one") == ["one"] and catalog.warm("docs").count() == 2
    catalog.set_read_only("docs", True)
    with pytest.raises(RequestError):
        catalog.writable("docs")
    catalog.set_read_only("docs", False)
    assert catalog.writable("docs").epoch == 1
    catalog.drop("other")
    assert catalog.list() == ["docs"]
    for bad in (lambda: catalog.create("docs", SCHEMA), lambda: catalog.create("a b", SCHEMA), lambda: catalog.open("other"), lambda: catalog.create("z", SCHEMA, text={"text": {"x": 1}}), lambda: catalog.list(page_size=0)):
        with pytest.raises(RequestError):
            bad()


def test_copies_follow(spark, catalog):
    s = catalog.create("docs", SCHEMA)
    s.write(1, upserts=rows(spark, [("x", 1, "p")]))
    s.write(2, upserts=rows(spark, [("y", 2, "q")]))
    assert catalog.copy("docs", "then", as_of=1).state().count() == 1
    c = catalog.copy("docs", "now", text={"text": {"stemming": True}})
    assert c.state().count() == 2 and catalog.analyzers("now")["text"].stemming
    assert not catalog.replicate("docs", "now")
    s.write(3, deletes=rows(spark, [("x", None, None)]).select("id"))
    assert catalog.replicate("docs", "now") and {r.id for r in catalog.open("now").state().collect()} == {"y"}


def test_external(spark, catalog, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<float>").write.parquet(f"{tmp_path}/t")
    catalog.register("ext", f"{tmp_path}/t", "v")
    catalog.copy_external("ext", "same")
    df, column = catalog.external("same")
    assert column == "v" and df.count() == 5
    with pytest.raises(RequestError):
        catalog.open("ext")
    with pytest.raises(RequestError):
        catalog.register("l", f"{tmp_path}/t", "v", kind="lance")
    catalog.drop("ext")
    assert catalog.list() == ["same"]


def test_small_indexes_are_searched_exactly_and_fragments_ranked(spark, tmp_path, monkeypatch):
    data = [(f"d{i}", "Common words here. A rare thing there." if i == 3 else "Common words here. Common words again.", [float(i), 1.0]) for i in range(30)]
    ix = Index(spark.createDataFrame(data, "id string, text string, vector array<float>"), metric="euclidean_squared")
    assert ix.with_clusters(f"{tmp_path}/c", 4) is ix
    monkeypatch.setattr(retrievers, "EXACT_BELOW", 10)
    near = ix.with_clusters(f"{tmp_path}/c", 4)
    assert near.clusters is not None and near.explain({"vector": [3.0, 1.0]})["legs"][0]["mode"] == "clusters"
    assert near.query({"vector": [3.0, 1.0], "top_k": 1}).first().id == "d3"
    e = {"best": ["Highlight", "text", {"rank_fragments_by": ["text", "BM25", "common rare"]}]}
    got = ix.query({"text": "rare", "top_k": 1, "compute_attributes": e}).first()
    assert got.best[0]["text"] == "A <em>rare</em> thing there."
