"""All queries by name, and their SQL."""

from __future__ import annotations

from . import bytecode, evaluation, features, files, intake, scans, traces

FAMILIES = (bytecode, scans, intake, traces, evaluation, features, files)
QUERIES = {k: f for m in FAMILIES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in FAMILIES for k, s in m.ORACLE_SQL.items()}
