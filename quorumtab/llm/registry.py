"""Queries of this subpackage and their DuckDB statements, by name."""

from __future__ import annotations

from quorumtab.llm import bpe, chat, exact_dedup, merkle, mixing, ngram_join, packing, pii, prefix_trie, quality_classifier, quality_rules, substring_dedup, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_chat": chat.op2_chat,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_bpe": bpe.op6_bpe,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_mixing": mixing.op10_mixing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_packing": packing.op12_packing,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {
    "op1_pii": pii.ORACLE,
    "op2_chat": chat.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
