"""Queries and SQL twins of the text operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ["line_dedup", "mixing", "exact_dedup", "jaccard_join", "html_text", "substring_dedup", "chat", "toxicity", "quality", "decontaminate", "byte_bpe", "word_runs", "prefix_trie"]


def all_queries() -> dict:
    found = {}
    for name in MODULES:
        found.update(import_module(f"tapeledger.llm.{name}").QUERIES)
    return found
