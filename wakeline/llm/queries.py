"""Queries of this subpackage and their SQL."""

from . import chat_format, decontaminate, language_id, license_scan, line_rules, mixing, near_dedup, quality_classifier, shards, token_counts

MODULES = [decontaminate, line_rules, token_counts, quality_classifier, shards, mixing, language_id, license_scan, chat_format, near_dedup]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
