"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import decontaminate, divergence, embedding_dup, exact_dup, html_extract, langid, merkle, mixing, near_dup, quality, suffix_dup, token_shards, toxicity

QUERIES = {
    "op1_ppm_language_id": langid.op1_ppm_language_id,
    "op2_max_subsequence_html": html_extract.op2_max_subsequence_html,
    "op3_minhash_near_dedup": near_dup.op3_minhash_near_dedup,
    "op4_suffix_array_dedup": suffix_dup.op4_suffix_array_dedup,
    "op5_feistel_token_shards": token_shards.op5_feistel_token_shards,
    "op6_wu_manber_decontamination": decontaminate.op6_wu_manber_decontamination,
    "op7_counterfactual_toxicity": toxicity.op7_counterfactual_toxicity,
    "op8_nbsvm_quality": quality.op8_nbsvm_quality,
    "op9_fair_queue_mixing": mixing.op9_fair_queue_mixing,
    "op10_cross_polytope_dedup": embedding_dup.op10_cross_polytope_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_cuckoo_exact_dedup": exact_dup.op13_cuckoo_exact_dedup,
}

ORACLES = {
    "op3_minhash_near_dedup": near_dup.OP3_SQL,
    "op6_wu_manber_decontamination": decontaminate.OP6_SQL,
    "op9_fair_queue_mixing": mixing.OP9_SQL,
    "op10_cross_polytope_dedup": embedding_dup.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_cuckoo_exact_dedup": exact_dup.OP13_SQL,
}
