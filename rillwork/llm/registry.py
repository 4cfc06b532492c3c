"""The queries of all operators here, and the SQL of those that SQL can express."""

from __future__ import annotations

from rillwork.llm import exact_dedup, html_text, line_dedup, mixing, nearest, ranked_search, sentencepiece_fst, sharding, simhash, token_counts, toxicity, url_filters, vector_codes

_MODULES = (token_counts, sentencepiece_fst, exact_dedup, toxicity, line_dedup, mixing, sharding, nearest, simhash, html_text, ranked_search, url_filters, vector_codes)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
