"""Queries and SQL of the corpus operators, one a dealt operator."""

from __future__ import annotations

from tessella.llm import boosted_rules, byte_bpe, decontaminate, language, pairwise_quality, personal, secrets, simhash, suffix_dedup, warc

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_secrets": secrets.op3_secrets,
    "op4_personal_data": personal.op4_personal_data,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_warc": warc.op6_warc,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality_rules": boosted_rules.op8_quality_rules,
    "op9_simhash": simhash.op9_simhash,
    "op10_pairwise_quality": pairwise_quality.op10_pairwise_quality,
}
#: The others are tested against brute force, the library or held-out labels in tests/llm.
SQL = {"op6_warc": warc.SQL}
