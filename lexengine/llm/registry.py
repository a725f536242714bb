"""The queries of the training-data operators and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexengine.llm import chat_format, ctw, exact_dedup, media, mixing, ngram_join, packing, phrases, pii, quality, repetition, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": ctw.op1_lm_scoring,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_packing": packing.op5_packing,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_warc": warc.op7_warc,
        "op8_media_columns": media.op8_media_columns,
        "op9_pii": pii.op9_pii,
        "op10_quality": quality.op10_quality,
        "op11_quality_rules": repetition.op11_quality_rules,
        "op12_phrase_mining": phrases.op12_phrase_mining,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat_format.OP2_SQL,
        "op3_exact_dedup": exact_dedup.OP3_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op11_quality_rules": repetition.OP11_SQL,
        "op12_phrase_mining": phrases.OP12_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
    }
