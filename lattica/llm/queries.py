"""The registered queries of this subpackage and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lattica.llm import ctw, decontaminate, language, mix, quality, secrets, shard, simhash, tokens, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": secrets.op1,
    "op2_quality_rules": quality.op2,
    "op3_simhash_near_dedup": simhash.op3,
    "op4_url_filters": urls.op4,
    "op5_token_counts": tokens.op5,
    "op6_source_mixing": mix.op6,
    "op7_lm_scoring": ctw.op7,
    "op8_sharding": shard.op8,
    "op9_language_id": language.op9,
    "op10_benchmark_decontamination": decontaminate.op10,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op10_benchmark_decontamination": decontaminate.SQL}
