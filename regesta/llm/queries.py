"""The operators' queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import exact_dedup, mixing, near_dedup, pii, quality, sentencepiece_codec, substring_dedup, token_ids, toxicity, warc

QUERIES = {
    "op1_token_ids": token_ids.op1_token_ids,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_warc": warc.op4_warc,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii": pii.op8_pii,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_quality_rules": quality.ORACLE,
}
