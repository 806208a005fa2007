"""Name -> query and name -> DuckDB SQL, gathered from the query modules."""

from __future__ import annotations

from lumenfold.plans import q_audit, q_distribution, q_joins, q_labels, q_matching, q_more, q_requirements, q_sources, q_text

MODULES = [q_matching, q_distribution, q_labels, q_text, q_joins, q_more, q_requirements, q_audit, q_sources]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
