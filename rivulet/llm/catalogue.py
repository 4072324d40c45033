"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import alignment, bpe, chat, decontamination, exact_dedup, importance, language_id, near_dedup, substring_dedup, suffix_dedup, token_counts, toxicity, vector_graph


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_chat_format": chat.op3_chat_format,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_decontamination": decontamination.op6_decontamination,
        "op7_language_id": language_id.op7_language_id,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_vector_graph": vector_graph.op11_vector_graph,
        "op12_importance": importance.op12_importance,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": suffix_dedup.ORACLE,
        "op5_near_dedup": near_dedup.ORACLE,
        "op6_decontamination": decontamination.ORACLE,
        "op9_exact_dedup": exact_dedup.ORACLE,
        "op10_substring_dedup": substring_dedup.ORACLE,
        "op11_vector_graph": vector_graph.ORACLE,
        "op12_importance": importance.ORACLE,
    }
