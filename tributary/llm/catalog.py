"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import chat, decontam, embedding, jaccard, line_dedup, packing, pii, pipeline, secrets, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": pii.op1_pii_surrogates,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_packing": packing.op4_packing,
        "op5_chat_format": chat.op5_chat_format,
        "chat_layouts": chat.chat_layouts,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_jaccard_join": jaccard.op7_jaccard_join,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_decontaminate": decontam.op9_decontaminate,
        "op10_embedding_dedup": embedding.op10_embedding_dedup,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.SQL,
        "op5_chat_format": chat.SQL,
        "chat_layouts": chat.LAYOUTS_SQL,
        "op7_jaccard_join": jaccard.SQL,
        "op10_embedding_dedup": embedding.SQL,
    }
