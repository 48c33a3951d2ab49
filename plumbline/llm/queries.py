"""The subpackage's queries and their SQL."""

from __future__ import annotations

from plumbline.llm import embed_dedup, license_scan, line_dedup, lsm_dedup, mixing, simhash, sp_sampling, substring_dedup, toxicity, url_rules

QUERIES = {
    "op1_url_filters": url_rules.op1_url_filters,
    "op2_sentencepiece": sp_sampling.op2_sentencepiece,
    "op3_mixing_sources": mixing.op3_mixing_sources,
    "op4_exact_dedup": lsm_dedup.op4_exact_dedup,
    "op5_embedding_dedup": embed_dedup.op5_embedding_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

SQL = {
    "op1_url_filters": url_rules.OP1_SQL,
    "op3_mixing_sources": mixing.OP3_SQL,
    "op4_exact_dedup": lsm_dedup.OP4_SQL,
    "op5_embedding_dedup": embed_dedup.OP5_SQL,
}
