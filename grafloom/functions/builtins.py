"""Functions of the query language, by name, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grafloom.errors import GraphError


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0.0 if a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def _similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def _normalized(a: Column) -> Column:
    n = norm(a) + 1e-12
    return F.transform(a, lambda x: x.cast("double") / n)


#: name: (fewest arguments, most, function)
SCALAR = {
    "abs": (1, 1, F.abs), "round": (1, 1, lambda x: F.bround(x.cast("double"), 0)), "ceil": (1, 1, lambda x: F.ceil(x).cast("double")), "floor": (1, 1, lambda x: F.floor(x).cast("double")),
    "length": (1, 1, F.char_length), "upper": (1, 1, F.upper), "lower": (1, 1, F.lower), "starts_with": (2, 2, F.startswith), "ends_with": (2, 2, F.endswith), "contains": (2, 2, F.contains),
    "coalesce": (1, 8, F.coalesce), "year": (1, 1, F.year), "month": (1, 1, F.month), "day": (1, 1, F.dayofmonth),
    "size": (1, 1, F.size), "head": (1, 1, lambda x: F.try_element_at(x, F.lit(1))), "last": (1, 1, lambda x: F.try_element_at(x, F.lit(-1))), "sort": (1, 1, F.array_sort),
    "similarity": (2, 2, _similarity), "cosine_similarity": (2, 2, cosine), "cosine_distance": (2, 2, lambda a, b: 1 - cosine(a, b)), "dot_product": (2, 2, dot), "l2_distance": (2, 2, l2),
    "vec_norm": (1, 1, norm), "vec_normalize": (1, 1, _normalized),
    "trim": (1, 1, F.trim), "substring": (3, 3, F.substr), "concat": (1, 8, F.concat), "to_string": (1, 1, lambda x: x.cast("string")), "to_float": (1, 1, lambda x: x.try_cast("double")), "to_int": (1, 1, lambda x: x.try_cast("bigint")),
}

AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp,
    "collect": lambda x: F.transform(F.collect_list(F.struct(x.alias("v"))), lambda y: y["v"]), "percentile": lambda x, p: F.percentile(x, p),
}


#: Names in SQL of aggregates that have another one there.
DISTINCT = {"stddev": "stddev_samp"}


def call(name: str, args: list[Column]) -> Column:
    least, most, f = SCALAR.get(name, (0, 0, None))
    if f is None:
        raise GraphError(6020, f"unknown function {name}")
    if not least <= len(args) <= most:
        raise GraphError(6060, f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(*args)
