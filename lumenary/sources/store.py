"""A versioned index as folders of Parquet: a log of operations, folded states, and a list of commits.

``ops/epoch=E`` has the operations of epoch E, ``state/epoch=E`` the rows after it, ``commits`` a row for each fold.
Files are never changed, so readers of an epoch see what it was while later ones are written.

Operations stand in the order of epoch, lane, seq, the position that their source gives, the kind (upserts, patches,
deletes) and the row's place in its batch; a state's ``pos`` is the epoch of the row's last change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import RequestError
from ..operators import fold as folding
from ..operators.predicates import Filters


#: What orders operations, after which comes their kind; all of a state's rows stand before those of later epochs.
ORDER = ("epoch", "lane", "seq", "pos")


class Store:
    """One index under ``path``; ``schema`` has the attributes and vectors without the id, which is ``id``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, vectors: Sequence[str] = (), id_type: str = "string"):
        self.spark, self.path, self.schema, self.vectors, self.id_type = spark, path.rstrip("/"), schema, tuple(vectors), id_type
        self.attributes = [f.name for f in schema.fields]

    # Files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def commits(self) -> list[int]:
        """Epochs that have a state, ascending."""
        if not self._exists(f"{self.path}/commits"):
            return []
        done = sorted(r.epoch for r in self._commits().select("epoch").distinct().collect())  # a row a fold
        at = f"{self.path}/vacuumed"
        floor = self.spark.read.parquet(at).agg(F.max("floor")).first()[0] if self._exists(at) else None
        return [e for e in done if floor is None or e >= floor]

    def _commits(self) -> DataFrame:
        return self.spark.read.schema("epoch long, rows long, key string").parquet(f"{self.path}/commits")

    @property
    def epoch(self) -> int:
        done = self.commits()
        return done[-1] if done else 0

    def _log_schema(self) -> T.StructType:
        own = [T.StructField("id", T._parse_datatype_string(self.id_type)), T.StructField("op", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("key", T.StringType()), T.StructField("row", T.LongType())]
        return T.StructType(own + list(self.schema.fields))

    def empty(self) -> DataFrame:
        """The state before any operation."""
        return self.spark.createDataFrame([], T.StructType([T.StructField("id", T._parse_datatype_string(self.id_type)), *self.schema.fields, T.StructField("pos", T.LongType())]))

    def state(self, as_of: int | None = None) -> DataFrame:
        """The folded rows, of now or of a past epoch; pending operations aren't among them."""
        done = self.commits()
        if as_of is not None and (as_of > (done[-1] if done else 0) or as_of < (done[0] if done else 0)):
            raise RequestError(f"epoch {as_of} is not kept")
        at = max((e for e in done if as_of is None or e <= as_of), default=None)
        return self.empty() if at is None else self.spark.read.parquet(f"{self.path}/state/epoch={at}")

    # Writes

    def ops(self, rows: DataFrame, op: str, fields: Sequence[str] = (), key: str | None = None) -> DataFrame:
        """Operations of one kind from rows of id and attributes, in the log's columns."""
        if op not in folding.OPS:
            raise RequestError(f"{op!r} is not an operation")
        have = set(rows.columns)
        if other := have - {"id", *self.attributes}:
            raise RequestError(f"{sorted(other)[0]!r} is not in the schema, which doesn't change")
        cols = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return rows.select(F.col("id").cast(self.id_type).alias("id"), F.lit(op).alias("op"), F.lit(0).cast("long").alias("pos"), F.array(*map(F.lit, fields)).cast("array<string>").alias("fields"), F.lit(key).cast("string").alias("key"), *cols)

    def append(self, epoch: int, ops: DataFrame, lane: int = 0, seq: int = 0) -> None:
        """Make operations durable under an epoch; written again, the same lane and seq replace themselves, so a batch
        that is tried twice counts once. ``pos`` orders the operations of a batch; where it is the same, upserts stand
        before patches and those before deletes, and then the rows keep the order that they have in ``ops``."""
        ops.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/ops/epoch={epoch}/lane={lane}/seq={seq}")

    def pending(self) -> DataFrame:
        """Operations after the last fold, in their order: epoch, lane, seq."""
        at = f"{self.path}/ops"
        if not self._exists(at):
            return self.spark.createDataFrame([], self._log_schema()).withColumns({c: F.lit(0).cast("long") for c in ORDER[:3]})
        log = self.spark.read.option("basePath", at).schema(T.StructType([*self._log_schema().fields, T.StructField("epoch", T.LongType()), T.StructField("lane", T.LongType()), T.StructField("seq", T.LongType())])).parquet(at)
        return log.filter(F.col("epoch") > self.epoch)

    def visible(self) -> DataFrame:
        """The folded rows with pending upserts and deletes; patches wait for the fold."""
        now = self.pending().filter(F.col("op").isin("upsert", "delete"))
        return self._folded(self.state(), now)

    def _folded(self, state: DataFrame, log: DataFrame) -> DataFrame:
        """The state after a log, whose operations have what ORDER names and ``row``."""
        kind = F.when(F.col("op") == "upsert", 0).when(F.col("op") == "patch", 1).otherwise(2)
        log = log.withColumn("pos", F.struct(*[F.col(c).cast("long").alias(c) for c in ORDER], kind.cast("long").alias("kind"), F.col("row").cast("long").alias("row")))
        before = F.lit(-1).cast("long")
        state = state.withColumn("pos", F.struct(F.col("pos").alias("epoch"), *[before.alias(c) for c in (*ORDER[1:], "kind", "row")]))
        return folding.fold(state, log, self.attributes, vectors=self.vectors).withColumn("pos", F.col("pos.epoch"))

    def fold(self, epoch: int) -> DataFrame:
        """Write the state after all pending operations as ``epoch``."""
        log = self.pending().filter(F.col("epoch") <= epoch)
        return self.commit(self._folded(self.state(), log), epoch)

    def commit(self, state: DataFrame, epoch: int, key: str | None = None) -> DataFrame:
        """Write a state, and then the one row that makes it the index's, with the request's ``key`` in it."""
        if epoch <= self.epoch:
            raise RequestError(f"epoch {epoch} is not after {self.epoch}")
        at = f"{self.path}/state/epoch={epoch}"
        state.write.mode("overwrite").parquet(at)
        out = self.spark.read.parquet(at)
        out.agg(F.lit(epoch).cast("long").alias("epoch"), F.count(F.lit(1)).alias("rows"), F.lit(key).cast("string").alias("key")).write.mode("append").parquet(f"{self.path}/commits")
        return out

    def write(self, epoch: int, upserts: DataFrame | None = None, patches: DataFrame | None = None, deletes: DataFrame | None = None, upsert_condition=None, patch_condition=None, delete_condition=None, patch_by_filter=None, delete_by_filter=None, allow_partial: bool = False, key: str | None = None) -> DataFrame:
        """One request, applied: upserts, then patches, deletes, patches by filter and deletes by filter, each kind with
        its condition on the current row. ``patches`` has the patched attributes as its columns. A ``key`` that an
        earlier request had makes this one do nothing. The state after it is returned."""
        if key is not None and self._keys(key):
            return self.state()
        state = self.state()
        placed = lambda log: log.withColumns({"epoch": F.lit(epoch), "lane": F.lit(0), "seq": F.lit(0), "row": F.lit(0)})
        kinds = (("upsert", upserts, upsert_condition), ("patch", patches, patch_condition), ("delete", deletes, delete_condition))
        for k, (op, rows, condition) in enumerate(kinds):
            if rows is None:
                continue
            log = self.ops(rows, op, [c for c in rows.columns if c != "id"] if op == "patch" else ()).withColumn("pos", F.lit(k).cast("long"))
            if condition is not None:
                log = folding.admitted(state, log, self._test(condition))
            state = self._folded(state, placed(log))
        if patch_by_filter is not None:
            changes = {a: F.lit(v) for a, v in patch_by_filter["patch"].items()}
            log = folding.by_filter(state, Filters(state).column(patch_by_filter["filters"]), "patch", changes, 3, allow_partial)
            state = self._folded(state, placed(log))
        if delete_by_filter is not None:
            log = folding.by_filter(state, Filters(state).column(delete_by_filter), "delete", None, 4, allow_partial)
            state = self._folded(state, placed(log))
        return self.commit(state, epoch, key)

    def _test(self, condition):
        def test(rows: DataFrame, new) -> Column:
            return Filters(rows, refs=new).column(condition)

        return test

    def _keys(self, key: str) -> bool:
        return self._exists(f"{self.path}/commits") and self._commits().filter(F.col("key") == key).limit(1).count() > 0

    def quarantine(self, rows: DataFrame, reason: str) -> None:
        """Keep rows that the schema doesn't admit beside the index, as JSON with the reason."""
        rows.select(F.to_json(F.struct("*")).alias("row"), F.lit(reason).alias("reason")).write.mode("append").parquet(f"{self.path}/quarantine")

    def quarantined(self) -> DataFrame:
        at = f"{self.path}/quarantine"
        return self.spark.read.parquet(at) if self._exists(at) else self.spark.createDataFrame([], "row string, reason string")

    # Copies and maintenance

    def branch(self, path: str, as_of: int | None = None) -> Store:
        """A new index that begins with this one's folded state."""
        other = Store(self.spark, path, self.schema, self.vectors, self.id_type)
        other.commit(self.state(as_of), max(1, as_of if as_of is not None else self.epoch))
        return other

    def vacuum(self, keep: int) -> None:
        """Remove states before epoch ``keep`` but for the last; past epochs before it are then refused. That is written
        down first, so a run that breaks off leaves files and no epoch without its state."""
        done = self.commits()
        gone = [e for e in done[:-1] if e < keep]
        if not gone:
            return
        floor = next(e for e in done if e not in gone)
        self.spark.createDataFrame([(floor,)], "floor long").write.mode("append").parquet(f"{self.path}/vacuumed")
        for e in gone:
            fs, at = self._fs(f"{self.path}/state/epoch={e}")
            fs.delete(at, True)

    def drop(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)
