"""A tenant's indexes: one folder each under a base path, listed by a small table of entries.

An entry is a row of ``_entries``: name, kind (store or external), schema, settings. Changes append a row; the last row of
a name counts, and a dropped one is a row too, so readers never meet a half-written list.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import Analyzer
from ..functions.values import RequestError
from . import tables
from .store import Store

NAME = re.compile(r"[A-Za-z0-9_.-]{1,128}")
MAX_FIELDS = 8


@dataclass(frozen=True)
class Entry:
    """What is known of an index."""

    name: str
    kind: str
    schema: str = ""
    vectors: tuple[str, ...] = ()
    id_type: str = "string"
    settings: dict = field(default_factory=dict)


class Catalog:
    """The indexes under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_entries")
        schema = "name string, at long, entry string"
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/_entries")

    def _put(self, name: str, entry: dict | None) -> None:
        self.spark.createDataFrame([(name, time.time_ns(), json.dumps(entry))], "name string, at long, entry string").coalesce(1).write.mode("append").parquet(f"{self.path}/_entries")

    def _live(self) -> DataFrame:
        last = F.row_number().over(Window.partitionBy("name").orderBy(F.col("at").desc()))
        return self._table().withColumn("_last", last).filter((F.col("_last") == 1) & (F.col("entry") != "null")).select("name", "entry")

    def entry(self, name: str) -> Entry:
        rows = self._live().filter(F.col("name") == name).collect()
        if not rows:
            raise RequestError(f"there is no index {name!r}")
        e = json.loads(rows[0].entry)
        return Entry(name, e["kind"], e.get("schema", ""), tuple(e.get("vectors", ())), e.get("id_type", "string"), e.get("settings", {}))

    def list(self, prefix: str = "", cursor: str | None = None, page_size: int = 100) -> list[str]:
        """Names with the prefix after the cursor, in their order."""
        if not 1 <= page_size <= 1000:
            raise RequestError("page_size is from 1 to 1000")
        rows = self._live().filter(F.startswith("name", F.lit(prefix)))
        rows = rows if cursor is None else rows.filter(F.col("name") > cursor)
        return [r.name for r in rows.orderBy("name").limit(page_size).collect()]

    # Stores

    def create(self, name: str, schema: T.StructType, vectors=(), id_type: str = "string", text: dict | None = None) -> Store:
        """A new index; ``text``: analyzer options by text field. The schema doesn't change afterwards."""
        if not NAME.fullmatch(name):
            raise RequestError("a name has 1 to 128 of A-Z a-z 0-9 _ . -")
        if self._live().filter(F.col("name") == name).count():
            raise RequestError(f"{name!r} exists")
        if len(vectors) > MAX_FIELDS or len(text or {}) > MAX_FIELDS + 1:
            raise RequestError(f"at most {MAX_FIELDS} named vector fields, and as many further text fields")
        for options in (text or {}).values():
            Analyzer.declared(options)
        self._put(name, {"kind": "store", "schema": schema.json(), "vectors": list(vectors), "id_type": id_type, "settings": {"text": text or {}, "read_only": False}})
        return self.open(name)

    def open(self, name: str) -> Store:
        e = self.entry(name)
        if e.kind != "store":
            raise RequestError(f"{name!r} is an external index")
        return Store(self.spark, f"{self.path}/{name}", T.StructType.fromJson(json.loads(e.schema)), e.vectors, e.id_type)

    def analyzers(self, name: str) -> dict[str, Analyzer]:
        return {f: Analyzer.declared(o) for f, o in self.entry(name).settings.get("text", {}).items()}

    def set_read_only(self, name: str, value: bool) -> None:
        e = self.entry(name)
        self._put(name, {"kind": e.kind, "schema": e.schema, "vectors": list(e.vectors), "id_type": e.id_type, "settings": e.settings | {"read_only": value}})

    def writable(self, name: str) -> Store:
        if self.entry(name).settings.get("read_only"):
            raise RequestError(f"{name!r} is read-only")
        return self.open(name)

    def drop(self, name: str) -> None:
        e = self.entry(name)
        if e.kind == "store":
            self.open(name).drop()
        self._put(name, None)

    def copy(self, name: str, to: str, as_of: int | None = None, text: dict | None = None) -> Store:
        """A new index with the folded rows of another, now or at an epoch; ``text`` declares other analyzers."""
        e = self.entry(name)
        other = self.create(to, T.StructType.fromJson(json.loads(e.schema)), e.vectors, e.id_type, e.settings.get("text") if text is None else text)
        other.commit(self.open(name).state(as_of), max(1, self.open(name).epoch if as_of is None else as_of))
        return other

    def replicate(self, name: str, to: str) -> bool:
        """Bring a copy up to its source's last epoch; whether there was anything to do."""
        source, copy = self.open(name), self.open(to)
        if source.epoch <= copy.epoch:
            return False
        copy.commit(source.state(), source.epoch)
        return True

    def summary(self, name: str) -> dict:
        s = self.open(name)
        return {"name": name, "rows": s.state().count(), "epoch": s.epoch, "schema": s.schema.simpleString(), "pending": s.pending().count(), "read_only": bool(self.entry(name).settings.get("read_only"))}

    def warm(self, name: str) -> DataFrame:
        """The state, kept in the executors' memory and disks."""
        from pyspark import StorageLevel

        df = self.open(name).state().persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        return df

    # External tables

    def register(self, name: str, source: str, column: str, kind: str = "parquet") -> DataFrame:
        """An index over a table that stays where it is."""
        if not NAME.fullmatch(name):
            raise RequestError("a name has 1 to 128 of A-Z a-z 0-9 _ . -")
        df = tables.external(self.spark, source, column, kind)
        self._put(name, {"kind": "external", "settings": {"source": source, "column": column, "kind": kind}})
        return df

    def external(self, name: str) -> tuple[DataFrame, str]:
        s = self.entry(name).settings
        return tables.external(self.spark, s["source"], s["column"], s["kind"]), s["column"]

    def copy_external(self, name: str, to: str) -> None:
        """Another name for the same table."""
        self._put(to, {"kind": "external", "settings": self.entry(name).settings})
