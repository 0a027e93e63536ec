"""All registered queries and their SQL, but for the corpus subpackage's."""

from __future__ import annotations

from . import code_queries, relational_queries, retrieval_queries, session_queries, source_queries, stream_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (retrieval_queries, text_queries, relational_queries, session_queries, source_queries, code_queries, stream_queries):
    QUERIES |= _part.R.queries
    ORACLE_SQL |= _part.R.sql
