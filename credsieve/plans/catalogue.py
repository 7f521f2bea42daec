"""All queries of the library and their SQL twins."""

from __future__ import annotations

from . import finding_queries, stage_queries, value_queries

_MODULES = [stage_queries, value_queries, finding_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
