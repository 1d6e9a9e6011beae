"""Rebuilding a table from a change feed: column-wise last-writer-wins, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.plans.runtime import broadcast_if_small, keep

#: Sequence numbers per block when the one before each is looked up; a task sorts at most so many of one log.
BLOCK = 65_536
#: A key with more than one in this many of the changes counts as hot: there are at most so many hot keys.
HOT_PART = 1_000


def conflicting(records: DataFrame, log: str, seq: str, prev: str) -> DataFrame:
    """Sequence numbers of which a log has records with different predecessors: `log_`, `seq_` and `good_prev`.

    `good_prev` is the greatest sequence number below it in its log, 0 if there is none: a record of this number with
    another `prev` is left over from a lost tail. A null `prev` counts as -1. Rows without log or number are dropped.
    """
    one = records.select(F.col(log).alias("log_"), F.col(seq).alias("seq_"), F.coalesce(F.col(prev), F.lit(-1)).alias("p")).where("log_ is not null and seq_ is not null")
    one = one.groupBy("log_", "seq_").agg(F.min("p").alias("p0"), F.max("p").alias("p1")).withColumn("block", F.floor(F.col("seq_") / BLOCK))
    inside = Window.partitionBy("log_", "block").orderBy("seq_")
    ahead = Window.partitionBy("log_").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = one.groupBy("log_", "block").agg(F.max("seq_").alias("top")).withColumn("before", F.max("top").over(ahead)).drop("top")
    found = one.withColumn("in_block", F.lag("seq_").over(inside)).where("p0 <> p1")
    return found.join(blocks, ["log_", "block"]).select("log_", "seq_", F.coalesce("in_block", "before", F.lit(0)).alias("good_prev"))


def valid_changes(changes: DataFrame, conflicts: DataFrame, log: str, seq: str, prev: str) -> DataFrame:
    """`changes` without those of left-over records; `conflicts` may be marked for broadcast."""
    c = conflicts
    at = (F.col(log) == c.log_) & (F.col(seq) == c.seq_)
    return changes.join(c, at, "left").where(c.good_prev.isNull() | (F.coalesce(F.col(prev), F.lit(-1)) == c.good_prev)).drop("log_", "seq_", "good_prev")


def committed_changes(changes: DataFrame, commits: DataFrame, log: str, tx: str) -> DataFrame:
    """`changes` that name no transaction, or one that `commits` (columns `log`, `tx`) has."""
    c = broadcast_if_small(commits.select(F.col(log).alias("log_c"), F.col(tx).alias("tx_c"), F.lit(True).alias("ok_c")).where("log_c is not null and tx_c is not null").distinct())
    return changes.join(c, (F.col(log) == c.log_c) & (F.col(tx) == c.tx_c), "left").where(F.col(tx).isNull() | c.ok_c).drop("log_c", "tx_c", "ok_c")


def _when(op: Column, *kinds: str) -> Column:
    return op.isin(*kinds)


def live_rows(changes: DataFrame, keys: list[str], seq: str, op: str, every: list[str] | None = None) -> DataFrame:
    """Last writer wins of the columns `every` that each insert, upsert and update sets: `keys`, these columns,
    `deleted_at` (null if never), `replaced_at` (last insert), `last`, `changes`, one row per key that is alive.

    Of each column the value of the greatest sequence number that sets it (`max_by`), if that comes after the key's
    latest delete. `op` is `insert`, `upsert`, `update` or `delete`; other kinds and rows with a null key or number
    change nothing. An insert or upsert makes a key alive, a delete ends it, an update counts only while it is alive.
    `last` is the number of the last insert, upsert or update that took effect. All of it is combined before the
    shuffle, so repeated and out-of-order changes and hot keys do no harm. At equal numbers a delete wins, and else the
    greatest value.
    """
    s, o = F.col(seq), F.col(op)
    rows = changes.where(s.isNotNull() & _when(o, "insert", "upsert", "update", "delete"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    sets = F.when(~_when(o, "delete"), s)
    per = rows.groupBy(*keys).agg(
        F.max(F.when(_when(o, "delete"), s)).alias("deleted_at"),
        F.max(F.when(_when(o, "insert"), s)).alias("replaced_at"),
        F.max(F.when(_when(o, "insert", "upsert"), s)).alias("set_at"),
        F.max(sets).alias("last"),
        F.count("*").alias("changes"),
        *[F.max_by(c, F.when(sets.isNotNull(), F.struct(s, F.col(c)))).alias(f"value_{c}") for c in every or []],
    )
    # After an effective insert or upsert every later update is effective, so the greatest number did take effect.
    alive = per.where("set_at is not null and (deleted_at is null or set_at > deleted_at)").drop("set_at")
    return alive.withColumnsRenamed({f"value_{c}": c for c in every or []})


def _to_changes(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` joined to what is known per key: hot keys by broadcast, as there are few, all others by a shuffle."""
    hot = F.col("changes") * HOT_PART > total
    parts = [F.broadcast(keyed.where(hot)), keyed.where(~hot)]
    a, b = [rows.join(k.drop("changes"), keys) for k in parts]
    return a.unionByName(b)


def last_writer_wins(changes: DataFrame, keys: list[str], seq: str, op: str, fields: str, within: str | None = None) -> DataFrame:
    """The live keys' columns: `keys`, `field`, `value`, `set_at`; `fields` is a map column of what a change sets.

    For each field the value of the last change that sets it (also to null), among the changes that took effect since
    the last delete or insert (an insert replaces the row, an upsert and an update set only their own fields). A live
    key that has no field gives no row here; `live_rows` has all keys. Two changes of one number that set one field
    differently: the one with the greater `within` (a place in the record) wins, then the greater value.
    """
    # Changes are used several times, and may be costly to parse.
    changes = keep(changes.select(*keys, seq, op, fields, *([within] if within else [])))
    live = keep(live_rows(changes, keys, seq, op))
    total = live.agg(F.sum("changes")).first()[0] or 0
    s, o = F.col(seq), F.col(op)
    rows = changes.where(_when(o, "insert", "upsert", "update") & s.isNotNull())
    since = _to_changes(rows, live.select(*keys, "deleted_at", "replaced_at", "changes"), keys, total).where(s > F.coalesce("deleted_at", F.lit(-(2**63))))
    since = keep(since)
    first = since.where(_when(o, "insert", "upsert")).groupBy(*keys).agg(F.min(s).alias("alive_at"))
    first = keep(first.join(live.select(*keys, "changes"), keys))
    took = _to_changes(since, first, keys, total).where(s >= F.greatest("alive_at", "replaced_at"))
    place = F.col(within) if within else F.lit(0)
    each = took.select(*keys, s.alias("s"), place.alias("w"), F.explode(fields).alias("field", "value"))
    return each.groupBy(*keys, "field").agg(F.max_by("value", F.struct("s", "w", "value")).alias("value"), F.max("s").alias("set_at"))
