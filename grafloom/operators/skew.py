"""Per-key results where a few keys hold most records: two-stage aggregation with salt on the heavy keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_id(rows: DataFrame, unique: str, columns: list[str]) -> DataFrame:
    """One row per `unique` (not null): of columns that differ between copies the greatest value, nulls last."""
    return rows.where(F.col(unique).isNotNull()).groupBy(unique).agg(*[F.max(c).alias(c) for c in columns])


def heavy_keys(rows: DataFrame, key: str, part: int = 100) -> list:
    """The values of `key` that hold at least one in `part` of all rows: at most `part` values, whatever the size."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    return sorted(r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("n") * part >= total)).select(key).collect())


def salted_aggregate(rows: DataFrame, keys: list[str], heavy: Column, spread: Column, salts: int, partial: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """Results per `keys` in two stages.

    `heavy` says whether a row's key is heavy, `spread` is a column whose hash spreads the rows of a key (a row id,
    not a random number: a task that is run again must give its rows the same salt). Stage one computes `partial` per
    key and salt, where rows of heavy keys have one of `salts` salts and all others have salt 0; stage two computes
    `merge`, over the columns of `partial`, per key. Null keys form a group; an empty table gives none.
    """
    salt = F.when(heavy, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    first = rows.groupBy(*keys, salt.alias("salt_")).agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])
