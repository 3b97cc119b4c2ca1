"""Queries and SQL of this package, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, hilbert_sharding, jaccard_join, language_id, line_dedup, merkle_manifest, mixing, packing, pu_quality, quality_rules, scaled_sketch, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_scaled_sketch": scaled_sketch.op2_scaled_sketch,
    "op3_poisson_mix": mixing.op3_poisson_mix,
    "op4_language_id": language_id.op4_language_id,
    "op5_minimum_bin_slack": packing.op5_minimum_bin_slack,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_pu_quality": pu_quality.op7_pu_quality,
    "op8_hilbert_sharding": hilbert_sharding.op8_hilbert_sharding,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "word_rule_counts": token_counts.word_rule_counts,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(),
    "op3_poisson_mix": mixing.oracle(),
    "op9_line_dedup": line_dedup.oracle(),
    "word_rule_counts": token_counts.oracle(),
    "op11_merkle_manifest": merkle_manifest.oracle(),
    "op12_suffix_dedup": suffix_dedup.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
