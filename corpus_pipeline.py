"""A training-data pipeline: quality rules, toxicity, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and reads all that the stage before it kept; the last one returns the pieces of
the packed sequences, the others rows of ``documents`` with all their columns (the first one takes frequent lines out of texts). Stages are written and read again in
between, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.llm import decontaminate, neardup, packing, quality, toxicity
from lumenary.llm.common import keep_rows, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, without their frequent lines."""
    return quality.cleaned(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted to be toxic; learnt from the labels of documents that are still there."""
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id, and all that have no words.

    Groups are told apart by their roots, as unlike documents may have no doc_id or the same one. Rows with equal doc_id, text and source are one document.
    """
    found = neardup.near_duplicates(docs)
    one = found.filter("n_shingles > 0").groupBy("component_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("x")).select("x.doc_id", "x.row_key")
    return keep_rows(docs, one.unionByName(found.filter("n_shingles = 0").select("doc_id", "row_key")), once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document is, in sequences of 2048 tokens."""
    return packing.packed_pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit),
]

#: The stages learn a model, hash sets and pack greedily, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
