"""The N best items of every group, by bounds that each partition finds for itself."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafloom.plans.runtime import BROADCAST_ROWS, keep, ship

#: Rows that a partition gathers before it merges them into its best so far.
MERGE_ROWS = 200_000


def partition_bounds(rows: DataFrame, n: int, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """Per group (`g`) the greatest of the partitions' own n-th best scores (`bound`), and the number of partitions that
    have one (`parts`); `rows` has `g`, `h`, `s`.

    `h` is a hash of the item. In a partition that has n items of a group, at least n items reach its n-th best score,
    so no better bound is needed to drop what lies below. Two items with one hash count as one, which can only lower
    a bound. Groups without n items in any partition have no bound. A partition holds at most `merge_rows` rows beside
    its best so far; where that grows beyond `merge_rows`, groups that have fewer than n items so far are given up.
    """
    ship(rows.sparkSession)
    kind = rows.schema["g"].dataType

    def best(tables: list):  # noqa: ANN202
        import pyarrow as pa

        p = pa.Table.from_batches(tables).to_pandas()
        p = p.sort_values("s", ascending=False, kind="stable").drop_duplicates(["g", "h"])
        return p[p.groupby("g").cumcount() < n]

    def bounds(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept, size, base, schema = [], 0, 0, None
        for batch in batches:
            schema = batch.schema
            kept.append(batch)
            size += batch.num_rows
            if size - base >= max(merge_rows, base):
                top = best(kept)
                if len(top) > merge_rows:  # a bound is never needed, so a group may go without
                    top = top[top.groupby("g")["s"].transform("size") >= n]
                kept = pa.Table.from_pandas(top, schema=schema, preserve_index=False).to_batches()
                size = base = sum(b.num_rows for b in kept)
        if size:
            p = best(kept)
            last = p[p.groupby("g").cumcount() == n - 1]
            yield pa.RecordBatch.from_pandas(last[["g", "s"]].rename(columns={"s": "bound"}), schema=pa.schema([schema.field("g"), pa.field("bound", pa.float64())]), preserve_index=False)

    found = rows.mapInArrow(bounds, f"g {kind.simpleString()}, bound double")
    return found.groupBy("g").agg(F.max("bound").alias("bound"), F.count("*").alias("parts"))


def top_items(rows: DataFrame, group: str, item: str, score: str, depth: str, n: int, bounds: int = BROADCAST_ROWS) -> DataFrame:
    """The `n` best distinct items of every group: `group`, `item`, `score`, `depth` and `rank` from 1.

    An item's row is its best one: highest score, then lowest depth, null depth last. Items are ranked by that row's
    score descending, depth ascending (null last), then item ascending by bytes; a group with fewer items gives all.
    Rows with null group or item, or null or NaN score, don't count; -0.0 equals 0.0. Repeated rows make no
    difference, an empty table gives no rows, and other columns are not read.

    Each partition's n-th best score per group bounds the group from below; the greatest bound is joined to the rows
    by broadcast, rows below it go, and only the rest is grouped and ranked: of a group of any size little more than n
    rows per partition are moved. At most `bounds` of them are broadcast, those of the groups that most partitions
    have a bound for; the other groups are in few partitions, and are ranked without. Rows that tie at the bound stay and are spread over all
    tasks by group and item, and of these again each task hands on n per group.
    """
    s = F.col(score).cast("double") + F.lit(0.0)
    base = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), s.alias("s"), F.col(depth).alias("d")).where("g is not null and i is not null and s is not null and not isnan(s)")
    bound = keep(partition_bounds(base.select("g", F.xxhash64("i").alias("h"), "s"), n))
    bound = bound if bound.limit(bounds + 1).count() <= bounds else bound.orderBy(F.desc("parts"), "g").limit(bounds)
    left = base.join(F.broadcast(bound.drop("parts")), "g", "left").where("bound is null or s >= bound")
    # The greatest (score, no null depth, -depth) of an item.
    one = left.groupBy("g", "i").agg(F.max(F.struct("s", (-F.col("d")).alias("up"))).alias("b")).select("g", "i", "b.s", (-F.col("b.up")).alias("d"))
    order = Window.partitionBy("g").orderBy(F.desc("s"), F.asc_nulls_last("d"), F.asc("i"))
    ranked = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("d").alias(depth), "rank")
