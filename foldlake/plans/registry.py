"""Queries over the given tables and the SQL that checks them."""

from . import backbone_queries, database_queries, pair_queries, quarantine_queries, sequence_queries, source_queries

_MODULES = (sequence_queries, backbone_queries, pair_queries, database_queries, source_queries, quarantine_queries)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.REGISTRY.queries.items()}
ORACLE_SQL: dict = {k: s for m in _MODULES for k, s in m.REGISTRY.sql.items()}
