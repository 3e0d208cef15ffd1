"""Comparison of a query's rows with those of DuckDB SQL over the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(value: object) -> object:
    """A value as it compares: numbers to nine digits, NaN as null, arrays and rows as tuples."""
    if hasattr(value, "item"):
        value = value.item()
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}") + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return value


def rows_of(df: DataFrame) -> list[tuple]:
    """All rows with columns by name, sorted."""
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    """Column names, and all rows with columns by name, sorted."""
    with duckdb.connect() as con:
        for path in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=lambda k: names[k])
        return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
