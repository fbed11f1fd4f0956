"""Queries of the corpus operators and the SQL they are held against."""

from __future__ import annotations

from . import divergence, exact_dedup, fast_minhash, jaccard_join, mixing, quality, sentencepiece_codec, sharding, suffix_dedup, token_counts, topk, toxicity, whitening

QUERIES = {
    "op1_quality": quality.query,
    "op2_token_counts": token_counts.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_source_mixing": mixing.query,
    "op5_sentencepiece": sentencepiece_codec.query,
    "op6_sharding": sharding.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_topk_search": topk.query,
    "op9_toxicity": toxicity.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_whitening": whitening.query,
    "op12_source_divergence": divergence.query,
    "op13_minhash": fast_minhash.query,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op8_topk_search": topk.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
