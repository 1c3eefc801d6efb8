"""All bid queries and their oracles."""

from __future__ import annotations

from basisline.plans import file_queries, ingest_queries, label_queries, queries, record_queries, store_queries  # noqa: F401  (each registers its queries)

QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL
entry = queries.latest_market_board
