"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from strandlake.plans import queries_cells, queries_datasets, queries_embedding, queries_eval, queries_formats, queries_functions, queries_io, queries_learned, queries_more, queries_relational, queries_signals, sql_twins

MODULES = (queries_functions, queries_cells, queries_relational, queries_signals, queries_io, queries_embedding, queries_more, queries_eval, queries_learned, queries_datasets, queries_formats, sql_twins)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
