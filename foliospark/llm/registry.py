"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import chat_format, decontaminate, embedding_dedup, hard_negatives, iso_media, language_id, lexical_search, line_dedup, packing, quality, secret_scan, simhash, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_packing": packing.op2_packing,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_simhash": simhash.op5_simhash,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_language_id": language_id.op7_language_id,
        "op8_quality": quality.op8_quality,
        "op9_media": iso_media.op9_media,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op4_chat_format": chat_format.OP4_SQL,
        "op6_secret_scan": secret_scan.OP6_SQL,
        "op11_lexical_search": lexical_search.OP11_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
    }
