"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from quarry.llm import (
    attention_quality,
    bpe,
    chat,
    extract,
    filter_audit,
    fingerprints,
    language,
    merkle,
    mixing,
    neardup,
    quality,
    sharding,
    token_files,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_bpe_prefix_dp": bpe.op2_bpe_prefix_dp,
    "op3_bottom_k_fingerprints": fingerprints.op3_bottom_k_fingerprints,
    "op4_chat_format": chat.op4_chat_format,
    "op5_byte_gru_language": language.op5_byte_gru_language,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_chosen_path_dedup": neardup.op7_chosen_path_dedup,
    "op8_hilbert_shards": sharding.op8_hilbert_shards,
    "op9_wavelet_token_files": token_files.op9_wavelet_token_files,
    "op10_dom_boosted_extract": extract.op10_dom_boosted_extract,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_attention_quality": attention_quality.op12_attention_quality,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

SQL = {
    "op1_mix_sources": mixing.SQL,
    "op4_chat_format": chat.SQL,
    "op6_quality_rules": quality.SQL,
    "op7_chosen_path_dedup": neardup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
