"""Named queries over the given tables, each with SQL that computes the same result."""

from . import axis, catalog, files, layout, mapped, stats, text, views

MODULES = (stats, axis, views, mapped, layout, catalog, text, files)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _sql) in m.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for m in MODULES for name, (_fn, sql) in m.QUERIES.items() if sql is not None}
