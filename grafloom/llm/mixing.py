"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.functions.prefix import running_before
from grafloom.plans.runtime import cut

#: Documents per block of a source's shuffled order, and tokens per block of the common queue.
BLOCK_DOCS, BLOCK_TOKENS = 50_000, 1 << 24


def _queue_end(sources: list[tuple[float, int, int]], budget: int) -> float | None:
    """A virtual time by which the queue has surely passed `budget`; None if it never does.

    `sources`: share, tokens in all allowed copies, largest document. At time v a source has been served at most
    share * v tokens, and lacks at most one document of that.
    """
    goal = budget + sum(x[2] for x in sources)
    if sum(t for _, t, _ in sources) <= goal:
        return None
    v, rest = 0.0, float(goal)
    for end, share in sorted((t / w, w) for w, t, _ in sources):
        rate = sum(w for w, t, _ in sources if t / w >= end)
        if rest <= rate * (end - v):
            return v + rest / rate
        v, rest = end, rest - rate * (end - v)
    return None


def mix_sources(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Picks from `docs` (`id`, `source`, `size`) so that each source has its share, and the shares reached.

    `targets`: `source` (distinct, not null), `share` (positive), `cap` (most times that a document may come); a table
    of a few thousand sources at most, as its rows go to the driver. `budget`: total size, by default half of what all
    documents of these sources have. Documents of other sources or of none, with null id, and with null or no size
    are left out. `id` must be unique; the order of documents depends on `seed` and `id` only.

    Every copy of a document gets a virtual finish time: the tokens of its source up to it, in shuffled order and copy
    after copy, divided by the source's share. The queue of all copies in order of (finish, source, copy, id) ends
    before the first that would pass the budget. While a source has documents left it keeps to its share of what is
    served; one that runs out leaves its part to the others, which the report shows.

    Picks: `id`, `source`, `copy` (from 1), `size`, `finish`. Report, one row per target: `source`, `target_share`,
    `actual_share` (of the total picked; 0 if nothing is), `size`, `picks`, `documents`, `copies` (most of one
    document), `available` (size of one copy of all), `state`: `met` (the share is reached, but for one document or 1 in
    100 of it), `over` (it has the part of sources that ran out, too), `under`, `exhausted`, `no documents`.
    """
    targets = targets.select("source", "share", "cap")
    sized = cut(docs.where("id is not null and size > 0").select("id", "source", F.col("size").cast("long")).join(F.broadcast(targets.select("source")), "source", "left_semi"))
    stats = sized.groupBy("source").agg(F.sum("size").alias("all"), F.max("size").alias("largest"), F.count("*").alias("n"))
    rows = targets.where("share > 0 and cap > 0").join(stats, "source").select("source", F.col("share").cast("double"), F.col("cap").cast("long"), "all", "largest", "n").collect()
    if budget is None:
        budget = sum(r["all"] for r in rows) // 2
    end = _queue_end([(r["share"], r["all"] * r["cap"], r["largest"]) for r in rows], budget)
    bits = max(4, math.ceil(math.log2(max(1, *[r["n"] for r in rows], 1) / BLOCK_DOCS)))
    facts = F.broadcast(docs.sparkSession.createDataFrame([(r["source"], r["share"], r["cap"], r["all"]) for r in rows], "source string, share double, cap bigint, all bigint"))

    turn = sized.withColumn("turn", F.xxhash64(F.lit(seed), "id"))
    turn = running_before(turn, ["source"], F.shiftright("turn", 64 - bits), [F.col("turn"), F.col("id")], {"ahead": ("sum", "size")})
    copies = turn.join(facts, "source").withColumn("upto", F.coalesce("ahead", F.lit(0)) + F.col("size"))
    most = F.col("cap") if end is None else F.least("cap", F.floor((F.lit(end) * F.col("share") - F.col("upto")) / F.col("all")) + 1)
    copies = copies.withColumn("most", most).where("most >= 1").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "most")))
    queue = copies.select("id", "source", "copy", "size", (((F.col("copy") - 1) * F.col("all") + F.col("upto")) / F.col("share")).alias("finish"))
    order = [F.col(c) for c in ("finish", "source", "copy", "id")]
    queue = running_before(queue, [], F.floor(F.col("finish") / BLOCK_TOKENS), order, {"served": ("sum", "size")})
    picks = queue.where(F.coalesce("served", F.lit(0)) + F.col("size") <= budget).select("id", "source", "copy", "size", "finish")

    per_doc = picks.groupBy("source", "id").agg(F.count("*").alias("times"), F.sum("size").alias("size"))
    got = per_doc.groupBy("source").agg(F.sum("size").alias("size"), F.sum("times").alias("picks"), F.count("*").alias("documents"), F.max("times").alias("copies"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = targets.join(got, "source", "left").join(stats.select("source", F.col("all").alias("available"), "largest"), "source", "left")
    report = report.select("source", F.col("share").cast("double").alias("target_share"), F.col("cap"), *map(zero, ("size", "picks", "documents", "copies", "available", "largest")))
    total = report.agg(F.sum("size").alias("total"))  # one row
    want = F.col("target_share") * F.col("total")
    near = F.abs(F.col("size") - want) <= F.greatest(0.01 * want, F.col("largest"))
    state = F.when(F.col("available") == 0, "no documents").when(F.col("size") >= F.col("available") * F.col("cap"), "exhausted").when(near, "met")
    state = state.otherwise(F.when(F.col("size") > want, "over").otherwise("under"))
    share = F.when(F.col("total") > 0, F.col("size") / F.col("total")).otherwise(0.0)
    report = report.crossJoin(F.broadcast(total)).select("source", "target_share", share.alias("actual_share"), "size", "picks", "documents", "copies", "available", state.alias("state"))
    return picks, report
