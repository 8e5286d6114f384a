"""Folding operations into the current version of every row.

A log has op (upsert, patch, delete), id, pos (its place in the order), fields (attributes that a patch names) and the
attributes as typed columns. Without conditions the fold is one grouped aggregate: the last upsert or delete of each id,
and for each attribute the last patch that names it. A conditional batch joins the current rows instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import RequestError, holds, unused

BOUND = 100_000
OPS = ("upsert", "patch", "delete")


def latest(log: DataFrame, attributes: Sequence[str], id_column: str = "id", vectors: Sequence[str] = ()) -> DataFrame:
    """id, attributes, pos of the last change: the rows that exist after the log, whose earliest entries may be the rows
    of an earlier state as upserts.

    A patch changes the attributes that it names (NULL unsets) and never a vector; one of an id without a version, or
    after its delete, does nothing. A hot id costs one state of its attributes in each task.
    """
    whole, of = F.col("op").isin("upsert", "delete"), unused(log.columns, "_of")
    base = F.max_by(F.struct("op", "pos", *[F.col(f"`{a}`") for a in attributes]), F.when(whole, F.col("pos")))
    aggs = [base.alias(of)]
    patched = [a for a in attributes if a not in vectors]
    for i, a in enumerate(patched):
        names = (F.col("op") == "patch") & F.array_contains("fields", a)
        aggs.append(F.max_by(F.struct("pos", F.col(f"`{a}`").alias("v")), F.when(names, F.col("pos"))).alias(f"{of}{i}"))
    got = log.groupBy(id_column).agg(*aggs).filter(F.col(f"{of}.op") == "upsert")
    newer = {a: F.col(f"{of}{i}.pos") > F.col(f"{of}.pos") for i, a in enumerate(patched)}
    cols = [F.when(holds(newer[a]), F.col(f"{of}{i}.v")).otherwise(F.col(f"{of}.`{a}`")).alias(a) for i, a in enumerate(patched)]
    cols += [F.col(f"{of}.`{a}`").alias(a) for a in vectors]
    pos = _latest_of(F.col(f"{of}.pos"), [F.when(newer[a], F.col(f"{of}{i}.pos")) for i, a in enumerate(patched)])
    out = got.select(F.col(id_column), *cols, pos.alias("pos"))
    return out.select(id_column, *[F.col(f"`{a}`") for a in attributes], "pos")


def _latest_of(base: Column, others: Sequence[Column]) -> Column:
    """The largest of some positions, which may be structs; those that are NULL don't count."""
    return F.array_max(F.array_compact(F.array(base, *others)))


def as_log(state: DataFrame) -> DataFrame:
    """A state's rows as upserts, to fold further operations onto."""
    return state.withColumns({"op": F.lit("upsert"), "fields": F.array().cast("array<string>")})


def fold(state: DataFrame, log: DataFrame, attributes: Sequence[str], id_column: str = "id", vectors: Sequence[str] = ()) -> DataFrame:
    """The state after a log of unconditional operations, all later than the state's own."""
    return latest(as_log(state).unionByName(log.select(id_column, "op", "pos", "fields", *[F.col(f"`{a}`") for a in attributes])), attributes, id_column, vectors)


def admitted(state: DataFrame, batch: DataFrame, condition: Callable[[DataFrame, Callable[[str], Column]], Column], id_column: str = "id") -> DataFrame:
    """The operations of one request whose condition holds: those whose current row it admits, and upserts of ids
    without a row. ``condition(rows, new)`` is a column over the current rows; ``new(a)`` is the operation's own value.

    A request names an id once for each kind of operation.
    """
    pre, here = unused(state.columns, "_new_"), unused((*state.columns, *batch.columns), "_here")
    new = batch.select(F.col(id_column), *[F.col(f"`{c}`").alias(f"{pre}{c}") for c in batch.columns if c != id_column])
    both = state.withColumn(here, F.lit(True)).join(new, id_column, "right")
    test = condition(both, lambda name: F.col(f"`{pre}{name}`") if f"{pre}{name}" in both.columns else F.lit(None))
    missing = F.col(here).isNull()
    kept = both.filter((missing & (F.col(f"{pre}op") == "upsert")) | (~missing & holds(test)))
    return kept.select(id_column, *[F.col(f"`{pre}{c}`").alias(c) for c in batch.columns if c != id_column])


def by_filter(state: DataFrame, test: Column, kind: str, changes: dict[str, Column] | None, pos: int, allow_partial: bool = False, bound: int = BOUND, id_column: str = "id") -> DataFrame:
    """The operations that deleting or patching by filter makes: one for each admitted row. More than ``bound`` rows are
    refused, or with ``allow_partial`` the ones with the smallest ids are taken."""
    rows = state.filter(test)
    if rows.limit(bound + 1).count() > bound:
        if not allow_partial:
            raise RequestError(f"the filter admits over {bound} rows")
        rows = rows.orderBy(F.col(id_column).asc()).limit(bound)
    changes = changes or {}
    cols = [changes.get(c, F.lit(None)).cast(state.schema[c].dataType).alias(c) for c in state.columns if c not in (id_column, "pos")]
    return rows.select(id_column, F.lit(kind).alias("op"), F.lit(pos).cast("long").alias("pos"), F.array(*map(F.lit, changes)).cast("array<string>").alias("fields"), *cols)


def as_of(log: DataFrame, epoch: int) -> DataFrame:
    """The operations up to an epoch."""
    return log.filter(F.col("epoch") <= epoch)
