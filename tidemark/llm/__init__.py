"""Operators for training-data pipelines; nothing else in the library imports this package."""

from __future__ import annotations

from tidemark.llm import bpe, chat, embedding_dedup, fingerprints, jaccard_join, language_id, mixing, prefix_trie, quality, spelling, substring_dedup, suffix_dedup, tokens

_OPERATORS = {"op1_language_id": language_id, "op2_chat_formatting": chat, "op3_fingerprints": fingerprints, "op4_suffix_dedup": suffix_dedup, "op5_source_mixing": mixing, "op6_token_counts": tokens, "op7_jaccard_join": jaccard_join, "op8_quality_rules": quality, "op9_substring_dedup": substring_dedup, "op10_byte_bpe": bpe, "op11_embedding_neardup": embedding_dedup, "op12_spelling_variants": spelling, "op13_prefix_trie": prefix_trie}

QUERIES = {name: module.query for name, module in _OPERATORS.items()}
ORACLE_SQL = {name: module.SQL for name, module in _OPERATORS.items() if getattr(module, "SQL", None)}
