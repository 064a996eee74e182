"""Queries of the corpus operators, and their SQL for comparison, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from riskweave.llm import htmlextract, langid, licenses, mixing, packing, quality, simhash, suffixdedup, topk, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_language": langid.op5_language,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffixdedup.op7_suffix_dedup,
    "op8_top_k": topk.op8_top_k,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_main_text": htmlextract.op10_main_text,
}

#: The others' hashes, token ids, automata and byte windows aren't expressible in SQL: tests hold them to brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.ORACLE,
    "op3_quality": quality.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
}
