"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, filter_audit, license_scan, quality_gam, rlz_dedup, simhash, spelling, suffix_dedup, token_shards, topk_search, url_filter

MODULES = (rlz_dedup, topk_search, quality_gam, decontaminate, license_scan, url_filter, byte_bpe, suffix_dedup, token_shards, simhash, chat_format, spelling, filter_audit)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
