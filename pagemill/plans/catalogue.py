"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pagemill.plans import box_queries, doc_queries, request_queries, source_queries

FLAGSHIP = "q_document_markdown"
QUERIES: dict = {}
SQL: dict = {}
for _module in (box_queries, doc_queries, request_queries, source_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
