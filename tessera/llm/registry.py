"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from tessera.llm import ann, bpe, matroska, maxent_lm, mixing, quality, sharding, simhash, token_files, url_filter


def queries() -> dict:
    return {
        "op1_ann": ann.op1_ann,
        "op2_token_files": token_files.op2_token_files,
        "op3_sharding": sharding.op3_sharding,
        "op4_simhash": simhash.op4_simhash,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_matroska": matroska.op6_matroska,
        "op7_quality": quality.op7_quality,
        "op8_maxent_lm": maxent_lm.op8_maxent_lm,
        "op9_bpe": bpe.op9_bpe,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter.ORACLE_SQL}
