"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

QUERIES = {
    "op1_decontaminate": "decontaminate",
    "op2_bpe": "bpe",
    "op3_substring_dedup": "substring_dedup",
    "op4_minhash_dedup": "minhash_dedup",
    "op5_language_id": "language_id",
    "op6_url_filters": "url_filters",
    "op7_line_dedup": "line_dedup",
    "op8_embedding_dedup": "embedding_dedup",
    "op9_token_counts": "token_counts",
    "op10_pii": "pii",
    "op11_quality": "quality",
    "op12_vector_codes": "vector_codes",
    "op13_conversations": "conversations",
}


def queries():
    return {name: import_module(f"{__package__}.{module}").query for name, module in QUERIES.items()}


def oracle_sql():
    out = {}
    for name, module in QUERIES.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "SQL", None)
        if sql:
            out[name] = sql
    return out
