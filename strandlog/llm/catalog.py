"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from . import bpe, chat, licenses, media, mixing, neardup, pii, quality, topk, toxicity


def queries() -> dict:
    found = (
        pii.op1_pii, topk.op2_topk, mixing.op3_mixing, chat.op4_preference, licenses.op5_licenses,
        toxicity.op6_toxicity, neardup.op7_minhash, media.op8_media, quality.op9_quality, bpe.op10_byte_bpe,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.OP2_SQL, "op3_mixing": mixing.op3_sql(), "op4_preference": chat.OP4_SQL}
