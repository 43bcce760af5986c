"""All queries of the library outside ``llm``, by name, and their SQL."""

from pagemill.plans import audit_queries, core_queries, file_queries, ingest_queries, stream_queries

_MODULES = [audit_queries, core_queries, ingest_queries, file_queries, stream_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
