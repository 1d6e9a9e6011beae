"""References to records that do not exist: runs of parent keys, and an as-of match of references to run starts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.plans.runtime import cut

#: Keys per bucket. A window group has at most this many runs and as many distinct references, whatever the skew.
BUCKET = 16_384
#: A key with more than one in this many of the suspicious references counts as hot: there are at most so many hot keys.
HOT_PART = 1_000


def key_runs(parents: DataFrame, key: str, created: str, deleted: str, bucket: int = BUCKET) -> DataFrame:
    """Contiguous runs of parent keys that share one visibility history.

    One row per run: `bucket`, `start`, `stop` (inclusive), `versions` - the sorted distinct [from, to) intervals of
    every key of the run, with the greatest bigint for an open end. Runs end at bucket borders, so that no task ever
    holds more than one bucket. Null keys and versions without a start are dropped; an empty table has no runs.
    """
    rows = parents.select(
        F.col(key).cast("long").alias("k"),
        F.struct(F.col(created).cast("long").alias("a"), F.coalesce(F.col(deleted).cast("long"), F.lit(2**63 - 1)).alias("b")).alias("v"),
    ).where("k is not null and v.a is not null")
    keys = rows.groupBy("k").agg(F.sort_array(F.collect_set("v")).alias("versions")).withColumn("bucket", _bucket(F.col("k"), bucket))
    # Within a history, key minus rank is constant along a run.
    same = Window.partitionBy("bucket", "versions").orderBy("k")
    return (
        keys.withColumn("island", F.col("k") - F.row_number().over(same))
        .groupBy("bucket", "versions", "island")
        .agg(F.min("k").alias("start"), F.max("k").alias("stop"))
        .select("bucket", "start", "stop", "versions")
    )


def _bucket(key: Column, width: int) -> Column:
    return F.floor(key / F.lit(width)).cast("long")


def asof_runs(keys: DataFrame, runs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """`keys` (a column `k`, distinct, not null) with the `versions` of the run that holds them, null beyond its end.

    Both sides meet in one sort per bucket; each key takes the last run that starts at or before it.
    """
    other = [c for c in keys.columns if c != "k"]
    left = keys.withColumns({"bucket": _bucket(F.col("k"), bucket), "run": F.lit(None).cast(f"struct<stop:bigint,versions:{dict(runs.dtypes)['versions']}>"), "is_key": F.lit(1)})
    right = runs.select(
        F.col("start").alias("k"), *[F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in other], "bucket", F.struct("stop", "versions").alias("run"), F.lit(0).alias("is_key")
    )
    before = Window.partitionBy("bucket").orderBy("k", "is_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("run", ignorenulls=True).over(before)
    return left.unionByName(right).withColumn("run", found).where("is_key = 1").select("k", *other, F.when(F.col("run.stop") >= F.col("k"), F.col("run.versions")).alias("versions"))


def orphan_references(
    children: DataFrame,
    ends: list[str],
    at: str,
    parents: DataFrame,
    key: str,
    created: str,
    deleted: str,
    keep: list[str],
    bucket: int = BUCKET,
    hot_part: int = HOT_PART,
) -> DataFrame:
    """Every reference of `children` to a parent key that is not visible at the reference's own time.

    For each row of `children` and each column of `ends`: columns `keep`, `endpoint` (the column's name), `key`, `at`
    and `reason`: `missing` (no version at all), `late` (all versions start after `at`), `deleted` (otherwise). Null
    references point to nothing and are no orphans. A null time sees no version: `missing` if there is none, else
    `deleted`. Repeated child rows give repeated result rows; an empty `parents` makes every reference `missing`.
    Other columns of either side are not read, so clashing names do no harm.

    1. References are reduced to one row per key with the earliest and latest time, which ends all skew before any
       row is shuffled. 2. An as-of match to the runs gives each key its history; keys seen at all times between
       these two have no orphan. 3. Only rows that point to the remaining keys are looked at again: those of hot keys
       (at most `hot_part`, so this side may be broadcast) and those of all others, by a shuffle join.
    """
    named = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    refs = children.select(*named, F.col(at).cast("long").alias("t"), F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(e).cast("long").alias("k")) for e in ends])).alias("e")).select(
        *[f"keep_{i}" for i in range(len(keep))], "t", "e.endpoint", "e.k"
    ).where("k is not null")
    span = (
        reduce(DataFrame.unionByName, [children.select(F.col(e).cast("long").alias("k"), F.col(at).cast("long").alias("t")) for e in ends])
        .where("k is not null")
        .groupBy("k")
        .agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.count("t").alias("n_t"))
    )
    seen = F.expr("n = n_t and exists(versions, v -> v.a <= t0 and t1 < v.b)")
    suspects = cut(asof_runs(span, key_runs(parents, key, created, deleted, bucket), bucket).where(F.coalesce(~seen, F.lit(True))).select("k", "versions", "n"))
    total = suspects.agg(F.sum("n")).first()[0] or 0
    hot_key = F.col("n") * hot_part > total
    hot, rest = F.broadcast(suspects.where(hot_key)), suspects.where(~hot_key)
    reason = (
        F.when(F.col("versions").isNull(), "missing")
        .when(F.expr("exists(versions, v -> v.a <= t and t < v.b)"), None)
        .when(F.expr("forall(versions, v -> v.a > t)"), "late")
        .otherwise("deleted")
    )
    joined = refs.join(hot.drop("n"), "k").unionByName(refs.join(rest.drop("n"), "k"))
    return joined.withColumn("reason", reason).where("reason is not null").select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "endpoint", F.col("k").alias("key"), F.col("t").alias("at"), "reason")


def orphan_report(orphans: DataFrame, of: str, period_at: str, by: list[str]) -> DataFrame:
    """Distinct records `of` per `by`, `endpoint`, month of the earliest `period_at`, and reason."""
    one = orphans.groupBy(of, "endpoint", "reason").agg(F.min(period_at).alias("first_at"), *[F.min(c).alias(c) for c in by])
    return one.groupBy(*by, "endpoint", F.date_format("first_at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("references"))
