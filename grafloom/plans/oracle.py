"""Comparing a query with its SQL: rows as a multiset, columns by name, as the correctness gate does."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path


def duck(sf_dir: str):  # noqa: ANN201
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def norm(x):  # noqa: ANN001, ANN201
    if x is None:
        return None
    if isinstance(x, float):
        return "NaN" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(norm(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, norm(v)) for k, v in x.items()))
    return x


def rows_of(arrow) -> tuple[list[str], Counter]:  # noqa: ANN001
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    return names, Counter(tuple(map(norm, r)) for r in zip(*columns, strict=True))


def differences(spark_arrow, duck_arrow) -> str:  # noqa: ANN001
    """Empty if equal, else what differs."""
    (a, x), (b, y) = rows_of(spark_arrow), rows_of(duck_arrow)
    if a != b:
        return f"columns {a} and {b}"
    if x == y:
        return ""
    return f"{x.total()} and {y.total()} rows; only Spark {list((x - y).items())[:4]}; only SQL {list((y - x).items())[:4]}"
