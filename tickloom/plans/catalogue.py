"""All registered queries with their SQL twins."""

from __future__ import annotations

from tickloom.plans import bar_queries, book_queries, execution_queries, fold_queries, indicator_queries, misc_queries, stat_queries

_ALL = (bar_queries.R, indicator_queries.R, fold_queries.R, book_queries.R, stat_queries.R, misc_queries.R, execution_queries.R)
QUERIES: dict = {name: q for r in _ALL for name, q in r.queries.items()}
ORACLE: dict = {name: q for r in _ALL for name, q in r.oracle.items()}
