"""Queries and oracle SQL of the corpus operators, gathered for __spark_entry__."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, hmm_lm, html_extract, langid, lexical_search, pieces, prefix_trie, simhash, token_files, toxicity, url_filter

MODULES = (hmm_lm, token_files, simhash, decontaminate, html_extract, url_filter, toxicity, bpe, langid, exact_dedup, pieces, prefix_trie, lexical_search)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
