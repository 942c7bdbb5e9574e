"""Queries of the ten operators, and the SQL of those that SQL can express."""

from quern.llm import ann, chat, compression_quality, line_dedup, mixing, near_dup, packing, quality_rules, secrets, token_counts

_MODULES = [ann, near_dup, mixing, token_counts, chat, packing, secrets, line_dedup, compression_quality, quality_rules]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
