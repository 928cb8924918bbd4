"""The subpackage's part of the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import chat_format, decontaminate, fingerprint, lm_score, mixing, ngram_join, quality, sharding, token_counts, url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict = {
    "op1_lm_scoring": lm_score.op1_lm_scoring,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_mixing": mixing.op6_mixing,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_chat_formatting": chat_format.op9_chat_formatting,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "pipeline": pipeline,
}

ORACLE_SQL: dict = {
    "op1_lm_scoring": lm_score.OP1_SQL,
    "op3_url_filters": url_filter.OP3_SQL,
}
