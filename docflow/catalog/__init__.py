"""Registered queries of the package's own operators, with the SQL that must give the same rows.

The tables at hand hold no page layouts; boxes, tags, sizes and strokes are fixed arithmetic on their columns, the same in
both engines.
"""

from __future__ import annotations

from . import assets, documents, files, layout, streams, tasks, web

_MODULES = (web, layout, documents, tasks, assets, files, streams)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
