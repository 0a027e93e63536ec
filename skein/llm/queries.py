"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("dedup", "mixing", "sharding", "quality", "toxicity", "fingerprints", "sstable", "packing", "html_layout", "ngram_lm", "token_counts", "audit", "lexical")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
