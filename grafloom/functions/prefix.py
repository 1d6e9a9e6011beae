"""Running sums and maxima along an order, without ever sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOLD = {"sum": F.sum, "max": F.max}


def running_before(rows: DataFrame, group: list[str], block: Column, order: list[Column], values: dict[str, tuple[str, str]]) -> DataFrame:
    """`rows` with, for each `name: (fold, column)` of `values`, the fold over all earlier rows of the group.

    `block` must not decrease along `order` within a group, and rows of one block must fit in one task; `order` must
    be total. One sort per block gives the fold inside it; one row per block, folded along the blocks of a group and
    joined back, gives what came before it. The first row gets null. Null group values form a group; `group` may be
    empty.
    """
    rows = rows.withColumn("block_", block)
    inside = Window.partitionBy(*group, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*group, "block_").agg(*[_FOLD[f](c).alias(f"{n}_all") for n, (f, c) in values.items()])
    blocks = blocks.select(*[F.col(g).alias(f"{g}_g") for g in group], F.col("block_").alias("block_g"), *[_FOLD[f](f"{n}_all").over(ahead).alias(f"{n}_ahead") for n, (f, _) in values.items()])
    here = rows.withColumns({f"{n}_in": _FOLD[f](c).over(inside) for n, (f, c) in values.items()})
    same = F.col("block_").eqNullSafe(F.col("block_g"))
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_g"))
    out = here.join(blocks, same, "left")

    def both(name: str, fold: str) -> Column:
        a, b = F.col(f"{name}_in"), F.col(f"{name}_ahead")
        return F.greatest(a, b) if fold == "max" else F.coalesce(a + b, a, b)

    return out.withColumns({n: both(n, f) for n, (f, _) in values.items()}).drop("block_", "block_g", *[f"{g}_g" for g in group], *[f"{n}_{x}" for n in values for x in ("in", "ahead")])
