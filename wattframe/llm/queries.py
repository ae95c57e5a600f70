"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from wattframe.llm import (
    bands, collocations, covertree, jaccard, langid, mixing, pieces, runindex, shards, substrings, topk, toxicity,
    whiten,
)

QUERIES = {
    "op1_suffix_array_dedup": runindex.op1_suffix_array_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_topk_search": topk.op8_topk_search,
    "op9_near_dedup": covertree.op9_near_dedup,
    "op10_sharding": shards.op10_sharding,
    "op11_embedding_whitening": whiten.op11_embedding_whitening,
    "op12_quality_rules": bands.op12_quality_rules,
    "op13_phrase_mining": collocations.op13_phrase_mining,
}

ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": runindex.ORACLE_SQL,
    "op4_substring_dedup": substrings.ORACLE_SQL,
    "op7_jaccard_join": jaccard.ORACLE_SQL,
    "op8_topk_search": topk.ORACLE_SQL,
    "op9_near_dedup": covertree.ORACLE_SQL,
    "op13_phrase_mining": collocations.ORACLE_SQL,
}
