"""All queries of the engine's own operators."""

from __future__ import annotations

from . import documents, facts, layout, pages, text

_MODULES = (facts, text, documents, pages, layout)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
