"""The queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import centroids, decontaminate, fill_middle, line_dedup, ngram_join, packing, pii, preference, quality, sharding, simhash, suffix_dedup, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_preference_prefix": preference.op1_preference,
        "op2_decontaminate_fm": decontaminate.op2_decontaminate,
        "op3_bounded_ring": sharding.op3_sharding,
        "op4_pii_bootstrap": pii.op4_pii,
        "op5_fuzzy_lines": line_dedup.op5_line_dedup,
        "op6_quality_risk": quality.op6_quality,
        "op7_token_orc": token_files.op7_token_files,
        "op8_pack_shortest_first": packing.op8_packing,
        "op9_suffix_deep_shallow": suffix_dedup.op9_suffix_dedup,
        "op10_simhash_pivots": simhash.op10_simhash,
        "op11_ngram_fragments": ngram_join.op11_ngram_fragments,
        "op12_kdtree_clusters": centroids.op12_kdtree_clusters,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_prefix": preference.ORACLE, "op12_kdtree_clusters": centroids.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
