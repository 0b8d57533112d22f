"""Ready-made queries over the given tables, each with its SQL twin.

A module's ``QUERIES`` maps a name to a function ``(spark, sf_dir)``; ``SQL``
holds the same query for an independent SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "versions",
    "reading",
    "updating",
    "history",
    "governance",
    "searching",
    "feeds",
    "storing",
    "histories",
]


# Result columns that hold exact decimals; handed out as doubles on both sides.
DECIMALS = {
    "o_totalprice": "d1 d2 d3 m5_merge3 m6_merge2 m7_merge_detect_abort m8 s5 t7_find_at_hash t7_merge t10 t11",
    "new_price": "m10",
    "balance": "t7_table c11_replay c11_undo_last r8",
    "after": "c10 d12",
    "before": "d12",
}
_WITHOUT = (
    "m6_merge2_dry_run", "t10_cherry_pick_counts", "c11_undo_last_log", "c10_op_log_by_table", "c10_op_log_by_user",
    "m10_merge_gate",
)


def _decimal_columns(name: str) -> list[str]:
    if name in _WITHOUT:
        return []
    parts = {c: tuple(f"{p}_" if p[-1].isdigit() and "_" not in p else p for p in starts.split())
             for c, starts in DECIMALS.items()}
    return [c for c, starts in parts.items() if name.startswith(starts)]


def _doubles(query: Query, columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: df[c].cast("double") for c in columns})

    return run


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL twins by name."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module_name in MODULES:
        module = import_module(f"{__name__}.{module_name}")
        for name, query in module.QUERIES.items():
            columns = _decimal_columns(name)
            queries[name] = _doubles(query, columns) if columns else query
            text = module.SQL.get(name)
            if text is not None:
                casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
                sql[name] = f"SELECT * REPLACE ({casts}) FROM ({text})" if columns else text
    return queries, sql
