"""All queries by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from terraframe.plans import base, display, formats, lookup, merge, roads

MODULES = (display, formats, lookup, merge, roads)
QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
FLAGSHIP = "edge_totals"
