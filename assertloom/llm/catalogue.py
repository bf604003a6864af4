"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assertloom.llm import bpe, chat, ngram_join, packing, pivots, quality_gam, quality_rules, recompression, token_store, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, which stands at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_join.query,
        "op2_substring_dedup": recompression.query,
        "op3_chat_formatting": chat.query,
        "op4_best_fit_packing": packing.query,
        "op5_token_store": token_store.query,
        "op6_embedding_near_dedup": pivots.query,
        "op7_quality_rules": quality_rules.query,
        "op8_bpe_round_trip": bpe.query,
        "op9_quality_classifier": quality_gam.query,
        "op10_warc_fixity_audit": warc.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.ORACLE,
        "op2_substring_dedup": recompression.ORACLE,
        "op3_chat_formatting": chat.ORACLE,
        "op6_embedding_near_dedup": pivots.ORACLE,
        "op7_quality_rules": quality_rules.oracle(),
        "op10_warc_fixity_audit": warc.ORACLE,
    }
