"""All queries of the core and their SQL twins."""

from __future__ import annotations

from starloom.queries import dynamics, fields, scalars, skewed, structure, system

_MODULES = [skewed, scalars, structure, fields, dynamics, system]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
