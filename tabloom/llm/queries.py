"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import byte_bpe, chat, fill_middle, gif, near_dedup, packing, quality, recompression, resampling, secrets, suffix_dedup, token_counts, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_chat": chat.op3_chat,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_secrets": secrets.op5_secrets,
    "op6_packing": packing.op6_packing,
    "op7_gif": gif.op7_gif,
    "op8_quality": quality.op8_quality,
    "op9_topk": topk.op9_topk,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_substring_dedup": recompression.op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat": chat.ORACLE_SQL,
    "op9_topk": topk.ORACLE_SQL,
    "op11_resampling": resampling.ORACLE_SQL,
    "op12_fill_middle": fill_middle.ORACLE_SQL,
    "op13_substring_dedup": recompression.ORACLE_SQL,
}
