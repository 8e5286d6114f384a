"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import counts, decontaminate, licenses, lm, neardup, ordering, packing, quality, sharding, toxicity
from .common import table


def op1_license_scan(spark, sf_dir):
    """Licences of every document."""
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_token_counts(spark, sf_dir):
    """Tokens of every document under a unigram segmentation."""
    return counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_toxicity(spark, sf_dir):
    """The toxicity of every document."""
    return toxicity.scored(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels")).drop("row_key")


def op4_quality_rules(spark, sf_dir):
    """Base counts and verdict of every document."""
    return quality.verdicts(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("row_key")


def op5_benchmark_leaks(spark, sf_dir):
    """Every benchmark item that a document contains."""
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op6_best_fit_packing(spark, sf_dir):
    """Where every piece of every document is, in sequences of 2048 tokens."""
    return packing.packed_pieces(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_minhash_neardup(spark, sf_dir):
    """The component of every document, over 2-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text", "source"), size=2).drop("row_key", "component_root")


def op8_token_shards(spark, sf_dir):
    """Every token sequence in training order, after writing the shards."""
    return ordering.materialise(table(spark, sf_dir, "documents", "doc_id", "text"), ordering.output_folder(spark))


def op9_extendible_sharding(spark, sf_dir):
    """The shard of every document, after writing the shards."""
    return sharding.write_shards(table(spark, sf_dir, "documents", "doc_id", "text"), sharding.LIMIT_BYTES, sharding.output_folder(spark))


def op10_lm_scores(spark, sf_dir):
    """Base and model scores of every document."""
    return lm.scored(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("row_key")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_benchmark_leaks": op5_benchmark_leaks,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_token_shards": op8_token_shards,
    "op9_extendible_sharding": op9_extendible_sharding,
    "op10_lm_scores": op10_lm_scores,
}
ORACLE_SQL = {"op1_license_scan": licenses.SQL, "op4_quality_rules": quality.SQL, "op9_extendible_sharding": sharding.SQL}
