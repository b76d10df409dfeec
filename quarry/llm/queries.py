"""Queries and SQL of this subpackage."""

from __future__ import annotations

from quarry.llm import exact, licenses, mixing, pages, pieces, quality, rules, shards, simhash, tokens

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_shards": shards.op3_shards,
    "op4_simhash": simhash.op4_simhash,
    "op5_html": pages.op5_html,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_quality": quality.op7_quality,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_token_files": tokens.op10_token_files,
}

ORACLE_SQL = {"op6_license_scan": licenses.OP6_SQL, "op8_exact_dedup": exact.OP8_SQL}
