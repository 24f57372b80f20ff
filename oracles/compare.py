"""Compare a Spark result with its DuckDB counterpart, value by value."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

# DuckDB's name for each Spark type that the results use.
_TYPE_NAMES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process database with a view per given table."""
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _duck_type(spark_type: str) -> str:
    return _TYPE_NAMES.get(spark_type, spark_type.upper())


def _row(values) -> tuple:
    return tuple(
        float(f"{v:.12g}") if isinstance(v, float) and math.isfinite(v) else v for v in values
    )


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs in names, types or rows; empty if nothing does."""
    relation = con.sql(sql)
    ours = {f.name: _duck_type(f.dataType.simpleString()) for f in df.schema}
    theirs = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if set(ours) != set(theirs):
        return [f"columns {sorted(set(ours) ^ set(theirs))}"]
    found = [
        f"type of {n}: {ours[n]} against {theirs[n].replace(' ', '')}"
        for n in ours
        if ours[n] != theirs[n].replace(" ", "")
    ]
    names = sorted(ours)
    left = Counter(_row(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    right = Counter(_row(r) for r in relation.select(quoted).fetchall())
    if not right:
        found.append("the DuckDB query returns no row, so nothing is compared")
    if left != right:
        missing, extra = list((right - left).items())[:2], list((left - right).items())[:2]
        found.append(
            f"rows {sum(left.values())} against {sum(right.values())}; "
            f"only DuckDB {missing}; only Spark {extra}"
        )
    return found
