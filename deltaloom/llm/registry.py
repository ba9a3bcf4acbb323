"""The queries of the corpus operators and the SQL that those which SQL can express must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import bpe, chat, decontamination, jaccard, language_model, quality, secrets, sharding, substrings, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_lpt_sharding": sharding.op2_lpt_sharding,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_pitman_yor": language_model.op5_pitman_yor,
    "op6_bpe": bpe.op6_bpe,
    "op7_prefix_targets": chat.op7_prefix_targets,
    "op8_quality": quality.op8_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "quality_ablations": quality.quality_ablations,
}
ORACLE = {
    "op1_secret_scan": secrets.ORACLE,
    "op4_substring_dedup": substrings.ORACLE,
    "op7_prefix_targets": chat.ORACLE,
    "op8_quality": quality.ORACLE,
    "op10_jaccard_join": jaccard.ORACLE,
    "quality_ablations": quality.ABLATION_ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
