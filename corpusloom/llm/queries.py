"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from corpusloom.llm import ann, byte_bpe, kneser_ney, merkle, minhash, positional_index, secrets, sharding, spelling, sql, substrings, token_counts, toxicity, url_filter

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle": merkle.op11_merkle,
    "op12_spelling": spelling.op12_spelling,
    "op13_secrets": secrets.op13_secrets,
    "op2_nearest": ann.op2_nearest,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_decontamination": positional_index.op4_decontamination,
    "op5_sharding": sharding.op5_sharding,
    "op6_minhash": minhash.op6_minhash,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_lm_scoring": kneser_ney.op8_lm_scoring,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
}

ORACLE_SQL = {
    "op11_merkle": sql.MANIFEST,
    "op12_spelling": sql.SPELLINGS,
    "op3_substring_dedup": sql.SUBSTRINGS,
    "op4_decontamination": sql.PHRASES,
    "op5_sharding": sharding.SQL,
    "op6_minhash": sql.NEAR_DUPLICATES,
    "op7_url_filters": url_filter.SQL,
}
