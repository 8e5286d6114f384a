"""Folds, the store, streams, external tables and exports."""

import datetime as dt
import random
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.functions.values import RequestError
from lumenary.operators import fold
from lumenary.sources import tables
from lumenary.sources.store import Store
from lumenary.streaming import ingest

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


def model(ops):
    """Operations in their order over current versions."""
    rows = {}
    for id_, op, _, fields, a, b, v in sorted(ops, key=lambda o: o[2]):
        if op == "upsert":
            rows[id_] = [a, b, v]
        elif op == "delete":
            rows.pop(id_, None)
        elif id_ in rows:
            for f in fields:
                if f in ("a", "b"):
                    rows[id_]["ab".index(f)] = {"a": a, "b": b}[f]
    return {i: tuple(r) for i, r in rows.items()}


def test_a_fold_is_the_operations_in_their_order(spark):
    rng = random.Random(4)
    ops = []
    for pos in range(3000):
        op = rng.choices(["upsert", "patch", "delete"], [3, 5, 1])[0]
        fields = rng.choice([["a"], ["b"], ["a", "b"]]) if op == "patch" else []
        ops.append((f"d{min(int(rng.expovariate(0.05)), 200)}", op, pos, fields, rng.choice([None, rng.randint(0, 99)]), rng.choice([None, "x", "y"]), [float(pos)]))
    log = spark.createDataFrame(ops, "id string, op string, pos long, fields array<string>, a long, b string, vector array<float>").repartition(5)
    out = fold.latest(log, ["a", "b", "vector"], vectors=["vector"])
    assert {r.id: (r.a, r.b, r.vector) for r in out.collect()} == model(ops)
    first, rest = log.filter("pos < 1500"), log.filter("pos >= 1500")
    two = fold.fold(fold.latest(first, ["a", "b", "vector"], vectors=["vector"]), rest, ["a", "b", "vector"], vectors=["vector"])
    assert {r.id: (r.a, r.b, r.vector) for r in two.collect()} == model(ops)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/index", SCHEMA, vectors=["vector"])


def rows(spark, data, columns="id string, a long, b string"):
    return spark.createDataFrame(data, columns)


def state(df):
    return {r.id: (r.a, r.b) for r in df.collect()}


def test_writes_visibility_folds_and_time_travel(spark, store):
    assert store.state().count() == 0 and store.epoch == 0
    store.append(1, store.ops(rows(spark, [("x", 1, "p"), ("y", 2, "q")]), "upsert"))
    assert state(store.visible()) == {"x": (1, "p"), "y": (2, "q")} and store.state().count() == 0
    assert state(store.fold(1)) == {"x": (1, "p"), "y": (2, "q")}
    store.append(2, store.ops(rows(spark, [("x", 9)], "id string, a long"), "patch", ["a"]), lane=0, seq=0)
    store.append(2, store.ops(rows(spark, [("y",)], "id string"), "delete"), lane=1, seq=0)
    store.append(2, store.ops(rows(spark, [("y",)], "id string"), "delete"), lane=1, seq=0)  # a second try
    assert state(store.visible()) == {"x": (1, "p")}  # patches wait
    assert state(store.fold(2)) == {"x": (9, "p")}
    assert state(store.state(1)) == {"x": (1, "p"), "y": (2, "q")} and store.commits() == [1, 2]
    for bad in (0, 3):
        with pytest.raises(RequestError):
            store.state(bad)
    with pytest.raises(RequestError):
        store.commit(store.state(), 2)
    other = store.branch(store.path + "-branch", 1)
    assert state(other.state()) == {"x": (1, "p"), "y": (2, "q")}
    store.vacuum(2)
    with pytest.raises(RequestError):
        store.state(1)
    store.drop()
    assert store.commits() == []


def test_conditions_filters_and_keys(spark, store):
    store.write(1, upserts=rows(spark, [("x", 1, "p"), ("y", 5, "q"), ("z", 9, "r")]))
    out = store.write(2, upserts=rows(spark, [("x", 3, "n"), ("y", 4, "n"), ("w", 0, "n")]), upsert_condition=["a", "Lt", {"$ref_new": "a"}])
    assert state(out) == {"x": (3, "n"), "y": (5, "q"), "z": (9, "r"), "w": (0, "n")}
    out = store.write(3, patches=rows(spark, [("x", "k"), ("z", "k"), ("nobody", "k")], "id string, b string"), patch_condition=["a", "Gte", 9], deletes=rows(spark, [("w",), ("y",)], "id string"), delete_condition=["b", "Eq", "n"])
    assert state(out) == {"x": (3, "n"), "y": (5, "q"), "z": (9, "k")}
    out = store.write(4, patch_by_filter={"filters": ["a", "Gt", 4], "patch": {"b": None}}, delete_by_filter=["a", "Eq", 3], key="once")
    assert state(out) == {"y": (5, None), "z": (9, None)}
    assert state(store.write(5, deletes=rows(spark, [("y",)], "id string"), key="once")) == {"y": (5, None), "z": (9, None)} and store.epoch == 4
    # One request: upserts, then patches, then deletes.
    out = store.write(6, upserts=rows(spark, [("v", 1, "u")]), patches=rows(spark, [("v", 2)], "id string, a long"), deletes=rows(spark, [("z",)], "id string"))
    assert state(out) == {"y": (5, None), "v": (2, "u")}


def test_bounds_of_filters(spark):
    s = spark.range(50).select(F.format_string("d%02d", "id").alias("id"), F.col("id").alias("a"), F.lit("x").alias("b"), F.lit(0).cast("long").alias("pos"))
    with pytest.raises(RequestError):
        fold.by_filter(s, F.col("a") >= 10, "delete", None, 1, bound=20)
    some = fold.by_filter(s, F.col("a") >= 10, "delete", None, 1, allow_partial=True, bound=20)
    assert sorted(r.id for r in some.collect()) == [f"d{i}" for i in range(10, 30)]


def test_schema_and_quarantine(spark, store):
    with pytest.raises(RequestError):
        store.ops(rows(spark, [("x", 1)], "id string, c long"), "upsert")
    with pytest.raises(RequestError):
        store.ops(rows(spark, [("x",)], "id string"), "merge")
    assert store.quarantined().count() == 0
    store.quarantine(rows(spark, [("x", 1)], "id string, c long"), "c is not in the schema")
    assert [r.row for r in store.quarantined().collect()] == ['{"id":"x","c":1}']


def test_streams(spark, store, tmp_path):
    src = f"{tmp_path}/src"
    for k in range(3):
        store.ops(rows(spark, [("x", k, "p"), (f"y{k}", k, "q")]), "upsert").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    ingest.into_log(stream, store, f"{tmp_path}/check", fold_every=2).awaitTermination()
    assert store.commits() == [2] and set(state(store.visible())) == {"x", "y0", "y1", "y2"}
    ingest.into_log(stream, store, f"{tmp_path}/check", fold_every=2).awaitTermination()  # nothing new
    assert set(state(store.fold(10))) == {"x", "y0", "y1", "y2"}


def test_streaming_aggregates(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    data = [(f"u{i % 3}", at + dt.timedelta(minutes=i), i) for i in range(30)]
    spark.createDataFrame(data, "u string, ts timestamp, v long").write.parquet(f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema("u string, ts timestamp, v long").parquet(f"{tmp_path}/e")

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert {(r.u, r.v) for r in run(ingest.latest_by_key(stream(), "u", "ts", ["v"]), "latest_t", "complete")} == {("u0", 27), ("u1", 28), ("u2", 29)}
    got = run(ingest.windowed(stream(), "ts", "10 minutes", "5 minutes", ["u"], {"n": F.count("*")}), "windows_t", "append")
    assert sum(r.n for r in got) in (20, 30) and len(run(ingest.deduplicated(stream(), ["u"], "ts", "1 hour"), "dedup_t", "append")) == 3


def test_external_tables(spark, tmp_path):
    v = [[0.1 * i, 1.0, -0.5] for i in range(20)]
    blobs = pa.array([struct.pack("<3f", *x) for x in v], pa.binary(12))
    pq.write_table(pa.table({"id": list(range(20)), "v": blobs, "w": pa.array(v, pa.list_(pa.float32())), "s": ["x"] * 20}), f"{tmp_path}/t.parquet")
    for column in ("v", "w"):
        d = tables.external(spark, f"{tmp_path}/t.parquet", column)
        got = tables.search_external(d, column, [1.0, 0.2, 0.0], 5, F.col("id") < 15).collect()
        assert [r.id for r in got] == [14, 13, 12, 11, 10]
    for bad in (("lance", "v"), ("csv", "v"), ("parquet", "nothing"), ("parquet", "s")):
        with pytest.raises(RequestError):
            tables.external(spark, f"{tmp_path}/t.parquet", bad[1], bad[0])


def test_exports(spark, tmp_path):
    d = spark.range(25).select(F.format_string("d%02d", "id").alias("id"), F.col("id").cast("int").alias("n"), F.array("id").alias("xs"), F.array(F.lit(1.0).cast("float")).alias("vector"), F.lit(dt.datetime(2024, 1, 1)).alias("at"), F.lit(1.5).cast("float").alias("f"))
    cursor, pages = None, 0
    while True:
        cursor = tables.export_page(d, f"{tmp_path}/{pages}", cursor, 10)
        pages += 1
        if cursor is None:
            break
    got = spark.read.parquet(*[f"{tmp_path}/{k}" for k in range(pages)])
    assert pages == 3 and got.count() == 25 and dict(got.dtypes) == {"id": "string", "n": "bigint", "xs": "string", "at": "timestamp", "f": "double"}
    with pytest.raises(RequestError):
        tables.export_page(d, f"{tmp_path}/x", None, 5000, with_vectors=True)


def test_batches_with_several_operations_of_an_id(spark, store):
    """Random logs through append, visible and fold, against operations one after another."""
    rng, done = random.Random(12), []
    columns = "id string, op string, pos long, fields array<string>, a long, b string, vector array<float>"
    for epoch in (1, 2, 1_000_000):
        batches = []
        for lane, seq in ((0, 0), (0, 5), (2, 1)):
            batch = []
            for pos in range(120):
                op = rng.choices(["upsert", "patch", "delete"], [3, 5, 1])[0]
                fields = rng.choice([["a"], ["b"], ["a", "b"]]) if op == "patch" else []
                batch.append((f"d{rng.randint(0, 25)}", op, pos, fields, rng.choice([None, rng.randint(0, 99)]), rng.choice([None, "x", "y"]), [float(pos)]))
            batches.append((lane, seq, batch))
        for lane, seq, batch in rng.sample(batches, 3):  # written in any order
            log = spark.createDataFrame(rng.sample(batch, len(batch)), columns).withColumn("key", F.lit(None).cast("string")).repartition(3)
            store.append(epoch, log, lane, seq)
        for x in (x for _, _, batch in batches for x in batch):
            done.append((*x[:2], len(done), *x[3:]))
        out = store.fold(epoch)
        assert {r.id: (r.a, r.b, r.vector) for r in out.collect()} == model(done)
        assert {r.pos for r in out.collect()} <= {1, 2, 1_000_000}
    assert state(store.write(1_000_001, patches=rows(spark, [("d1", 77)], "id string, a long"), upserts=rows(spark, [("d1", 5, "new")])))["d1"] == (77, "new")


def test_equal_positions_go_by_kind_then_row(spark, store):
    ups = store.ops(rows(spark, [("x", 1, "p"), ("x", 2, "q")]).coalesce(1), "upsert")
    store.append(1, store.ops(rows(spark, [("x", 9)], "id string, a long"), "patch", ["a"]).unionByName(ups))
    assert state(store.visible()) == {"x": (2, "q")} and state(store.fold(1)) == {"x": (9, "q")}
