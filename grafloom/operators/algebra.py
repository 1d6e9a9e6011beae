"""Relational operators that can be composed by hand, with the semantics of a columnar engine's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.errors import GraphError

_BINARY = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__", "and": "__and__", "or": "__or__", "add": "__add__", "sub": "__sub__", "mul": "__mul__", "div": "__truediv__", "mod": "__mod__"}


def compile_expr(e) -> Column:  # noqa: ANN001
    """A Column from nested tuples: `("col", name)`, `("lit", value)`, `("eq", a, b)` and so on, `("not", a)`,
    `("in", a, [values])`, `("is_null", a)`."""
    op, *args = e
    if op == "col":
        return F.col(f"`{args[0]}`")
    if op == "lit":
        return F.lit(args[0])
    if op == "not":
        return ~compile_expr(args[0])
    if op == "in":
        return compile_expr(args[0]).isin(list(args[1]))
    if op == "is_null":
        return compile_expr(args[0]).isNull()
    if op in _BINARY and len(args) == 2:
        return getattr(compile_expr(args[0]), _BINARY[op])(compile_expr(args[1]))
    raise GraphError(6010, f"unknown expression {op!r}")


def hash_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, kind: str = "inner", build_prefix: str = "", probe_prefix: str = "") -> DataFrame:
    """Equality join in which null matches null; `left` keeps all probe rows. Columns of build, then of probe."""
    if kind not in ("inner", "left"):
        raise GraphError(6040, f"unknown join kind {kind!r}")
    b = build.toDF(*[f"{build_prefix}{c}" for c in build.columns]).alias("b")
    p = probe.toDF(*[f"{probe_prefix}{c}" for c in probe.columns]).alias("p")
    on = F.col(f"b.`{build_prefix}{build_key}`").eqNullSafe(F.col(f"p.`{probe_prefix}{probe_key}`"))
    return p.join(b, on, kind).select("b.*", "p.*")


def _aggregate(column: str | None, kernel: str) -> Column:
    c = F.col(column) if column else None
    simple = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "avg": F.avg, "stddev": F.stddev_samp, "count_distinct": F.count_distinct}
    if kernel == "count_star" or (kernel == "count" and c is None):
        return F.count("*")
    if kernel in simple:
        return simple[kernel](c)
    if kernel in ("list", "collect"):
        return F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"])  # keeps nulls
    if kernel.startswith("percentile:"):
        return F.percentile(c, float(kernel.partition(":")[2]))
    raise GraphError(6041, f"unknown aggregate {kernel!r}")


def hash_aggregate(child: DataFrame, keys: list[str], aggregates: list[tuple[str | None, str, str]]) -> DataFrame:
    """`aggregates`: (column, kernel, name). Null is a group; without keys one row, also of an empty input."""
    return child.groupBy(*keys).agg(*[_aggregate(c, k).alias(n) for c, k, n in aggregates])


def top_k(child: DataFrame, keys: list[tuple[str, bool]], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted by `keys` (column, descending); nulls last either way, NaN just before them."""
    if offset < 0 or (limit is not None and limit < 0):
        raise GraphError(6042, "limit and offset must not be negative")
    order = []
    for name, descending in keys:
        c = F.col(name)
        if dict(child.dtypes)[name] in ("double", "float"):
            order.append(F.isnan(c).asc() if descending else F.isnan(c).asc_nulls_last())
            order[-1] = F.when(c.isNull(), 2).when(F.isnan(c), 1).otherwise(0).asc()
        order.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    out = child.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def union_frames(children: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, children)


def drop_trailing(child: DataFrame, names: list[str]) -> DataFrame:
    """Without the last of the columns of each name, so that of two equal names the first one stays."""
    columns = list(child.columns)
    keep = list(range(len(columns)))
    for n in names:
        at = [i for i in keep if columns[i] == n]
        if at:
            keep.remove(at[-1])
    plain = child.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{i}") for i in keep]).toDF(*[columns[i] for i in keep])


def triple_scan(edges: DataFrame, subject, object_) -> DataFrame:  # noqa: ANN001
    """One pattern over one relation: a `?name` binds, other values filter. Both fixed: `found`, a row per edge."""
    var = lambda x: isinstance(x, str) and x.startswith("?")
    rows = edges
    for end, x in (("src", subject), ("dst", object_)):
        if not var(x):
            rows = rows.where(F.col(end) == x)
    if var(subject) and var(object_):
        if subject == object_:
            return rows.where("src = dst").select(F.col("src").alias(subject[1:]))
        return rows.select(F.col("src").alias(subject[1:]), F.col("dst").alias(object_[1:]))
    if var(subject):
        return rows.select(F.col("src").alias(subject[1:]))
    if var(object_):
        return rows.select(F.col("dst").alias(object_[1:]))
    return rows.select(F.lit(True).alias("found"))


def basic_graph_pattern(relations: dict[str, DataFrame], triples: list[tuple]) -> DataFrame:
    """The natural join of triple patterns `(subject, relation, object)`."""
    parts = [triple_scan(relations[p], s, o) for s, p, o in triples]
    out = parts[0]
    for part in parts[1:]:
        shared = [c for c in part.columns if c in out.columns]
        out = out.join(part, shared) if shared else out.crossJoin(part)
    return out
