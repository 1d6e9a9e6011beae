"""Traversals: level by level joins of a frontier with the adjacency, never one node at a time.

The order in which nodes are discovered is kept as a key: the array of the steps that led there. Of several ways to a
node at one depth, the one with the least key is the first; arrays compare element by element, so no global numbering
is needed, and the path can be read off the key. Each level is written once to the shared folder. The steps from few
nodes come from a filtered scan, those from many from a table that is written once, see `Steps`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.errors import GraphError
from grafloom.graph import PropertyGraph, first_steps
from grafloom.plans.runtime import IN_KEYS, Kept, among, broadcast_if_small, cut, few, keep

SCORES = ("sum", "average", "avg", "min", "max", "product")


def path_score(weights: Column, mode: str | None) -> Column:
    """A path's score from the weights of its edges; null without a mode."""
    if mode is None:
        return F.lit(None).cast("double")
    if mode not in SCORES:
        raise GraphError(6020, f"unknown path score {mode!r}")
    if mode in ("min", "max"):
        return (F.array_min if mode == "min" else F.array_max)(weights)
    if mode == "product":
        return F.aggregate(weights, F.lit(1.0), lambda a, x: a * x)
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return total if mode == "sum" else F.when(F.size(weights) > 0, total / F.size(weights))


def out_edges(g: PropertyGraph, nodes: DataFrame, edge_type: str, incoming: bool = False) -> DataFrame:
    """`src`, `dst`, `eid` of the edges that leave (or reach) `nodes` (`gid`), in their own direction."""
    e, end = g.edges(edge_type), "dst" if incoming else "src"
    return e.join(nodes.select("gid").distinct(), e[end] == F.col("gid"), "left_semi").select("src", "dst", "eid")


def degree(g: PropertyGraph, edge_type: str, direction: str = "out", nodes: DataFrame | None = None) -> DataFrame:
    """`gid`, `degree`; with `nodes` each of these, 0 if it has no edge. `both` is out plus in."""
    e = g.edges(edge_type)
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    counts = reduce(DataFrame.unionAll, [e.select(F.col(c).alias("gid")) for c in ends]).where("gid is not null").groupBy("gid").agg(F.count("*").alias("degree"))
    if nodes is None:
        return counts
    return nodes.select("gid").distinct().join(counts, "gid", "left").select("gid", F.coalesce("degree", F.lit(0)).alias("degree"))


def common_neighbors(g: PropertyGraph, left: int, right: int, edge_type: str, direction: str = "out") -> DataFrame:
    adj = g.adjacency([edge_type], direction).select("node", "next")
    return adj.where(F.col("node") == left).select(F.col("next").alias("gid")).intersect(adj.where(F.col("node") == right).select(F.col("next").alias("gid")))


def overlap(g: PropertyGraph, node: int, candidates: DataFrame, edge_type: str, direction: str = "out", top_k: int | None = None) -> DataFrame:
    """`gid`, `overlap`: for each candidate (`gid`) how many distinct neighbours it shares with `node`; 0 is kept."""
    adj = g.adjacency([edge_type], direction).select("node", "next")
    mine = adj.where(F.col("node") == node).select("next").distinct()
    shared = adj.join(mine, "next", "left_semi").distinct().groupBy("node").agg(F.count("*").alias("n"))
    out = candidates.select("gid").distinct().join(shared, F.col("gid") == F.col("node"), "left").select("gid", F.coalesce("n", F.lit(0)).alias("overlap"))
    return out if top_k is None else out.orderBy(F.desc("overlap"), "gid").limit(top_k)


def _step_key(by_weight: bool) -> Column:
    """What a step adds to a key: first what orders the steps of a node, then the rest of it."""
    first = (-F.col("w") if by_weight else F.lit(0.0)).alias("s")
    return F.struct(first, F.col("edge_type").alias("t"), F.col("eid").alias("e"), F.col("next").alias("n"), F.col("w").alias("w"), F.col("direction").alias("d"))


def _seed_paths(seeds: DataFrame) -> DataFrame:
    """`seeds`: `pos`, `gid`. A path of no steps per distinct seed."""
    one = seeds.groupBy("gid").agg(F.min("pos").alias("pos"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit("").alias("t"), F.col("pos").cast("long").alias("e"), F.col("gid").alias("n"), F.lit(0.0).alias("w"), F.lit("").alias("d"))
    return one.select(F.col("gid").alias("at"), F.array(start).alias("key"))


def with_path(df: DataFrame) -> DataFrame:
    """`df` with the columns of the path that its `key` holds: `nodes`, `eids`, `types`, `directions`, `weights`."""
    rest = lambda f: F.slice(F.col(f"key.{f}"), F.lit(2), F.size("key") - 1)
    return df.withColumns({"nodes": F.col("key.n"), "eids": rest("e"), "types": rest("t"), "directions": rest("d"), "weights": rest("w")})


class Steps:
    """The steps of a graph, level by level from the nodes that a traversal has come to.

    While these are few they are looked up by an IN filter that goes down into the scan. From the first larger level
    on, or the `LEVELS`-th, the steps are written once to the shared folder, sorted by node (the steps of a hub go to
    several files), and all further levels read that.
    """

    LEVELS = 3

    def __init__(self, source: DataFrame | Callable, top: int | None = None) -> None:
        """`source`: steps, or what gives the steps of a list of nodes (of all, if it is null); `top`: see `first_steps`."""
        self.source, self.top, self.kept, self.levels = source, top, None, 0

    def all(self) -> DataFrame:
        if self.kept is None:
            steps = self.source if isinstance(self.source, DataFrame) else self.source(None)
            columns = [c for c in ("node", "next", "edge_type", "eid", "w", "direction") if c in steps.columns]
            self.kept = keep(steps.select(*columns).repartitionByRange(*[c for c in ("node", "eid") if c in columns]).sortWithinPartitions("node"))
        return self.kept

    def of(self, nodes: list[int] | None) -> DataFrame:
        """The steps from `nodes`; from all where it is null."""
        self.levels += 1
        if nodes is None or self.kept is not None or self.levels >= self.LEVELS:
            steps = self.all()
        else:
            steps = self.source if isinstance(self.source, DataFrame) else self.source(nodes)
        if nodes is not None:
            steps = steps.where(among("node", nodes))
        return steps if self.top is None else first_steps(steps, self.top)


def steps_of(g: PropertyGraph, edge_types: list[str] | None = None, direction: str = "out", filters: dict | None = None, weight: str = "weight", top: int | None = None) -> Steps:
    g.adjacency(edge_types, direction)  # wrong arguments fail at once
    return Steps(lambda nodes: g.adjacency(edge_types, direction, filters, weight, only=nodes, properties=False), top)


def _extend(frontier: DataFrame, steps: DataFrame, by_weight: bool, keep_: list[str] | None = None) -> DataFrame:
    """Every path of the frontier, one step longer."""
    j = frontier.join(steps, F.col("at") == F.col("node"))
    return j.select(*(keep_ or []), F.col("next").alias("to"), F.concat("key", F.array(_step_key(by_weight))).alias("key")).withColumnRenamed("to", "at")


@dataclass
class Reached:
    """The nodes that a traversal has reached: `at`, `depth`, `key`; `nodes` lists them if they are few."""

    rows: DataFrame
    nodes: list[int] | None
    before: list[int] | None = None  # those before the last level


def breadth_first(steps: Steps, seeds: DataFrame, depth: int, by_weight: bool = False) -> Reached:
    """Every node reached within `depth` steps, once, by the first way to it.

    The seeds count as visited, and are in the result at depth 0. A level is one write of its new nodes and one look
    at them.
    """
    known = Kept(seeds.sparkSession)
    frontier = known.add(_seed_paths(seeds).withColumn("depth", F.lit(0)))
    now = few(frontier, "at")
    seen, before = now, []
    for d in range(1, depth + 1):
        if now == []:
            break
        new = _extend(frontier.drop("depth"), steps.of(now), by_weight)
        new = new.groupBy("at").agg(F.min("key").alias("key")).join(known.all().select("at"), "at", "left_anti")
        frontier = known.add(new.select("at", "key", F.lit(d).alias("depth")))
        before, now = seen, few(frontier, "at")
        seen = None if seen is None or now is None or len(seen) + len(now) > IN_KEYS else seen + now
    return Reached(known.all(), seen, before)


def union_levels(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def neighbors(
    g: PropertyGraph, seeds: DataFrame, edge_types: list[str] | None = None, direction: str = "out", depth: int = 1, limit: int | None = None, node_types: list[str] | None = None,
    edge_filters: dict | None = None, weight: str = "weight", top_edges_per_node: int | None = None, score: str | None = None, order_by_score: str | None = None,
) -> DataFrame:
    """Nodes within `depth` steps of any seed (`pos`, `gid`), each at its first discovery: `node_id`, `node_type`,
    `internal_id`, `depth`, `via_edge_id`, `via_edge_type`, `path_score`, `path_node_ids` (gids), `path_edge_ids`,
    `path_edge_types`. `node_types` restricts the result, not the traversal. In order of discovery, or with
    `order_by_score` (`asc`, `desc`) of score, depth and id; `limit` keeps the first so many."""
    steps = steps_of(g, edge_types, direction, edge_filters, weight, top_edges_per_node)
    reached = breadth_first(steps, seeds, depth, top_edges_per_node is not None)
    found = with_path(reached.rows.where("depth > 0"))
    rows = g.named(found, "at", reached.nodes).withColumn("path_score", path_score(F.col("weights"), score))
    if node_types:
        rows = rows.where(F.col("node_type").isin(node_types))
    order = [F.col("depth"), F.col("key")]
    if order_by_score:
        order = [F.desc_nulls_last("path_score") if order_by_score == "desc" else F.asc_nulls_last("path_score"), F.col("depth"), F.col("at")]
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    return rows.select(
        F.coalesce("node_id", F.col("at").cast("string")).alias("node_id"), "node_type", F.col("at").alias("internal_id"), "depth", F.element_at("eids", -1).alias("via_edge_id"), F.element_at("types", -1).alias("via_edge_type"),
        "path_score", F.col("nodes").alias("path_node_ids"), F.col("eids").alias("path_edge_ids"), F.col("types").alias("path_edge_types"),
    )


def k_hop(g: PropertyGraph, seeds: DataFrame, depth: int, edge_types: list[str] | None = None, direction: str = "both", max_nodes: int | None = 500, max_edges: int | None = 2000) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` steps (the seeds at depth 0) and every edge seen on the way, those to known nodes too.

    With caps, the first `max_nodes` in order of discovery and the first `max_edges` in order of (depth, type, eid).
    """
    reached = breadth_first(steps_of(g, edge_types, direction), seeds, depth)
    nodes = g.named(reached.rows, "at", reached.nodes)
    if max_nodes is not None:
        nodes = nodes.orderBy("depth", "key").limit(max_nodes)
    nodes = nodes.select(F.coalesce("node_id", F.col("at").cast("string")).alias("node_id"), "node_type", F.col("at").alias("internal_id"), "depth")
    passed = reached.rows.where(F.col("depth") < depth).select(F.col("at").alias("node"), (F.col("depth") + 1).alias("depth"))
    seen = passed.join(g.adjacency(edge_types, direction, only=reached.before, properties=False), "node")
    edges = seen.groupBy("edge_type", "eid").agg(F.min("depth").alias("depth"), F.min("src").alias("src"), F.min("dst").alias("dst"))
    if max_edges is not None:
        edges = edges.orderBy("depth", "edge_type", "eid").limit(max_edges)
    return nodes, edges


def _pairs(steps: Steps, nodes: list[int] | None) -> DataFrame:
    return steps.of(nodes).select("node", "next").distinct()


def reachable(adj: DataFrame | Steps, seeds: DataFrame, hop_min: int, hop_max: int) -> DataFrame:
    """Distinct pairs `seed`, `dst` with `hop`, the number of steps at which the pair is first seen.

    Hop 0 is the seed itself, if `hop_min` is 0; otherwise a seed can be reached again by a cycle. A pair first seen
    before `hop_min` is never in the result.
    """
    if hop_min < 0 or hop_max < hop_min:
        raise GraphError(6031, f"invalid hops {hop_min} to {hop_max}")
    steps = adj if isinstance(adj, Steps) else Steps(adj)
    known = Kept(seeds.sparkSession)
    frontier = known.add(seeds.select(F.col("gid").alias("seed"), F.col("gid").alias("dst")).distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hop_max + 1):
        now = few(frontier, "dst")
        if now == []:
            break
        new = frontier.join(_pairs(steps, now), F.col("dst") == F.col("node")).select("seed", F.col("next").alias("dst")).distinct()
        seen = known.all() if hop_min == 0 else known.all().where("hop > 0")
        frontier = known.add(new.join(seen.select("seed", "dst"), ["seed", "dst"], "left_anti").withColumn("hop", F.lit(hop)))
    return known.all().where(F.col("hop") >= hop_min)


def reachable_per_depth(adj: DataFrame | Steps, seeds: DataFrame, depth: int) -> DataFrame:
    """Distinct `seed`, `node`, `depth` for every depth up to `depth`: a node counts again at each depth."""
    steps, known = adj if isinstance(adj, Steps) else Steps(adj), Kept(seeds.sparkSession)
    now = known.add(seeds.select(F.col("gid").alias("seed"), F.col("gid").alias("here")).distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        nodes = few(now, "here")
        if nodes == []:
            break
        new = now.join(_pairs(steps, nodes), F.col("here") == F.col("node")).select("seed", F.col("next").alias("here")).distinct()
        now = known.add(new.withColumn("depth", F.lit(d)))
    return known.all().where("depth > 0").withColumnRenamed("here", "node")


def _distances(steps: DataFrame, targets: DataFrame, depth: int | None) -> DataFrame:
    """`id`, `left`: the fewest steps from a node to any target, up to `depth` (None: any number); each node once, from
    the targets back."""
    known = Kept(steps.sparkSession)
    frontier = known.add(targets.select(F.col("gid").alias("id")).distinct().withColumn("left", F.lit(0)))
    for d in count(1) if depth is None else range(1, depth + 1):
        if frontier.isEmpty():
            break
        new = steps.join(frontier.select("id"), F.col("next") == F.col("id"), "left_semi").select(F.col("node").alias("id")).distinct()
        frontier = known.add(new.join(known.all().select("id"), "id", "left_anti").withColumn("left", F.lit(d)))
    return known.all()


@dataclass
class Best:
    """What the first `limit` paths are looked for by: their score, or its negative, then depth, nodes and edges."""

    limit: int
    score: str | None
    order: str
    most: float = math.inf  # the greatest absolute weight of a step; infinite where that is unknown

    def steps(self, steps: DataFrame, max_depth: int | None) -> DataFrame:
        """Of the parallel steps from a node to the next those that can be in one of these paths.

        In a path of the same nodes, a step may take the place of another. A step is left out if `limit` others of the same
        weight have lesser ids, as each of these gives a path that comes first. For sums and averages it is left out, too,
        if `limit` others are better by more than what rounding can make up for in the sum: then ids don't come to decide.
        """
        columns, v = steps.columns, F.lit(0.0) if self.score is None else F.col("w") if self.order == "desc" else -F.col("w")
        ids = [F.col(c) for c in ("eid", "edge_type", "direction")]
        out = steps.withColumn("v_", v).withColumn("n_", F.row_number().over(Window.partitionBy("node", "next", "v_").orderBy(*ids))).where(F.col("n_") <= self.limit)
        if self.limit and max_depth is not None and self.score in ("sum", "average", "avg") and self.most * max_depth < 1e300:
            slack = self.most * max(1e-9, 1e-15 * max_depth**2)
            every = Window.partitionBy("node", "next").orderBy(F.desc("v_")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out = out.withColumn("k_", F.nth_value("v_", self.limit).over(every)).where(F.col("k_").isNull() | (F.col("v_") >= F.col("k_") - slack))
        return out.select(*columns)


def simple_paths(adj: DataFrame | Steps, sources: DataFrame, targets: DataFrame | None, max_depth: int | None, min_depth: int = 1, stop: bool = False, by_weight: bool = False, best: Best | None = None) -> DataFrame:
    """All paths without a repeated node from each source (`pos`, `gid`) to a target (`gid`; None: any node).

    `seed`, `at`, `depth` and the path's columns; parallel edges give paths of their own. With `stop`, paths don't go
    on from a target. Without `max_depth` the search ends when no path goes on: a path has no more steps than there
    are other nodes. Then, and where there are at most `IN_KEYS` targets, a path of which the rest can't reach a
    target in time is dropped as soon as that is known, by distances from the targets back. With `best`, paths that can't
    be among the first ones may be left out.
    """
    if max_depth is not None and max_depth < 1:
        raise GraphError(6020, "max_depth must be at least 1")
    steps, spark = adj if isinstance(adj, Steps) else Steps(adj), sources.sparkSession
    left = None
    if targets is not None:
        targets = targets.select("gid").distinct()
        if max_depth is None or (max_depth > 1 and few(targets, "gid") is not None):
            left = _distances(steps.all(), targets, None if max_depth is None else max_depth - 1)
    if best is not None and left is not None:
        greatest = steps.all().agg(F.max(F.abs("w"))).first()[0]  # NaN is the greatest
        best = replace(best, most=0.0 if greatest is None else greatest)
    known = Kept(spark)
    at_work = known.add(_seed_paths(sources).select(F.col("at").alias("seed"), "at", "key", F.lit(0).alias("depth"), F.lit(False).alias("hit")))
    last = None
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        nodes = few(at_work, "at")
        if nodes == []:
            break
        live = at_work.where(~F.col("hit")) if stop else at_work
        ways = steps.of(nodes)
        if best is not None:
            if left is not None:
                near = left if max_depth is None else left.where(F.col("left") <= max_depth - d)
                ways = ways.join(near, F.col("next") == F.col("id"), "left_semi")
            ways = best.steps(ways, max_depth)
        # The new node is checked against the path before it, so that the arrays are only made for paths that stay.
        step = _extend(live.select("seed", "at", "key", F.col("key.n").alias("before")), ways, by_weight, ["seed", "before"]).where(~F.array_contains("before", F.col("at"))).drop("before")
        hit = F.lit(True)
        if left is not None:
            step = step.join(left.select(F.col("id").alias("at"), "left"), "at").where(F.lit(True) if max_depth is None else F.col("left") <= max_depth - d)
            hit = F.col("left") == 0
        elif targets is not None:
            step = step.join(targets, F.col("at") == F.col("gid"), "left_semi" if d == max_depth else "left")
            hit = F.lit(True) if d == max_depth else F.col("gid").isNotNull()
        step = step.select("seed", "at", "key", F.lit(d).alias("depth"), hit.alias("hit"))
        if d == max_depth:  # the widest level is not written
            last = step
        else:
            at_work = known.add(step)
    found = known.all().where(F.col("hit") & (F.col("depth") >= min_depth))
    return with_path((found if last is None else found.unionByName(last)).drop("hit"))


def paths(g: PropertyGraph, source: int, target: int, edge_types: list[str] | None = None, max_depth: int = 3, limit: int | None = 20, direction: str = "out", edge_filters: dict | None = None, score: str | None = None, weight: str = "weight", order: str = "desc") -> DataFrame:
    """Simple paths between two gids, the first `limit` in order of (score,) depth, nodes and edges."""
    spark = g.spark
    one = lambda x: spark.createDataFrame([(0, x)], "pos bigint, gid bigint")
    p = simple_paths(steps_of(g, edge_types, direction, edge_filters, weight), one(source), one(target), max_depth, best=None if limit is None else Best(limit, score, order))
    p = p.where(F.lit(source != target)).withColumn("path_score", path_score(F.col("weights"), score))
    by = [F.col("depth"), F.col("nodes"), F.col("eids")]
    if score:
        by = [F.desc_nulls_last("path_score") if order == "desc" else F.asc_nulls_last("path_score"), *by]
    p = p.orderBy(*by)
    p = keep((p if limit is None else p.limit(limit)).select("seed", "at", "depth", "nodes", "eids", "types", "directions", "path_score"))
    # Properties are read for the edges of these paths only.
    each = p.select("nodes", "eids", F.posexplode(F.arrays_zip(F.col("types").alias("t"), F.col("eids").alias("e"))).alias("i", "x")).select("nodes", "eids", "i", F.col("x.t").alias("edge_type"), F.col("x.e").alias("eid"))
    used = few(each, "eid")
    known = g.adjacency(edge_types, "out").select("edge_type", "eid", "properties")
    known = known if used is None else known.where(among("eid", used))
    props = each.join(known, ["edge_type", "eid"]).groupBy("nodes", "eids").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "properties"))), lambda x: x["properties"]).alias("properties"))
    return p.join(props, ["nodes", "eids"]).orderBy(*by).select("seed", "at", "depth", F.col("nodes").alias("internal_node_ids"), F.col("eids").alias("edge_ids"), F.col("types").alias("relation_types"), "directions", F.col("properties").alias("edge_properties"), "path_score")


def _completions(steps: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """`id`, `hit` (is a target) and `u1` to `u<depth>`: the greatest product of absolute weights of a way of 1 to that
    many steps from there to a target, null if there is none."""
    end = targets.select(F.col("gid").alias("id")).distinct()
    known, last = end.withColumn("hit", F.lit(True)), end.withColumn("b", F.lit(1.0))
    for d in range(1, depth + 1):
        way = steps.join(last, F.col("next") == F.col("id"))
        last = broadcast_if_small(way.groupBy("node").agg(F.max(F.abs("w") * F.col("b")).alias("b")).withColumnRenamed("node", "id"))
        known = known.join(last.withColumnRenamed("b", f"u{d}"), "id", "full")
        if d > 1:
            known = known.withColumn(f"u{d}", F.greatest(f"u{d - 1}", f"u{d}"))
    return known.withColumn("hit", F.coalesce("hit", F.lit(False)))


def best_products(adj: DataFrame | Steps, sources: DataFrame, targets: DataFrame, max_depth: int, best: int, beam: int = 2) -> DataFrame:
    """The simple paths to targets whose product of weights is at least that of the `best`-th one of their source.

    `seed`, `at`, `depth`, `score`, `nodes`, `eids`, `types`: at least `best` paths of a source, if it has so many, and
    all that equal the last of them. A narrow search (the `beam` times `best` most promising paths of a source per
    level) finds real paths, the `best`-th of which is a lower bound; a path is dropped only if no rest of it can reach
    the bound. So the result is exact for any weights, and the search is as wide as the weights make it.
    """
    if max_depth < 1:
        raise GraphError(6020, "max_depth must be at least 1")
    steps = (adj if isinstance(adj, Steps) else Steps(adj)).all().select("node", "next", "edge_type", "eid", "w")
    known = broadcast_if_small(_completions(steps, targets, max_depth - 1))
    steps = steps.join(known, F.col("next") == F.col("id")).drop("id")
    none = lambda t: F.array().cast(f"array<{t}>")
    start = sources.select(F.col("gid").alias("at")).distinct().select("at", F.col("at").alias("seed"), F.lit(1.0).alias("score"), F.array("at").alias("nodes"), none("bigint").alias("eids"), none("string").alias("types"))

    def promise(d: int) -> Column:
        """What a path of `d` steps may still come to; a little more, as products are rounded in another order."""
        return F.abs("score") * F.col(f"u{max_depth - d}") * (1 + 1e-9) + 1e-300 if d < max_depth else F.lit(None).cast("double")

    def level(frontier: DataFrame, d: int, *keep: str) -> DataFrame:
        j = frontier.withColumnRenamed("score", "before").join(steps, F.col("at") == F.col("node")).where(~F.array_contains("nodes", F.col("next"))).withColumn("score", F.col("before") * F.col("w")).withColumn("promise", promise(d))
        add = lambda old, x: F.concat(old, F.array(x)).alias(old)
        if keep:  # with the bound, which is applied before arrays are made
            j = j.where((F.col("hit") & (F.col("score") >= F.col("bound"))) | (F.col("promise") >= F.col("bound")))
        return j.select("seed", F.col("next").alias("at"), "score", add("nodes", "next"), add("eids", "eid"), add("types", "edge_type"), "hit", "promise", *keep)

    by_seed = Window.partitionBy("seed")
    frontier, found = start, []
    for d in range(1, max_depth + 1):
        step = level(frontier, d)
        kth = F.row_number().over(by_seed.orderBy(F.desc("score")))
        found.append(cut(step.where("hit").select("seed", "score").withColumn("n", kth).where(F.col("n") <= best).drop("n")))
        if d < max_depth:
            first = F.row_number().over(by_seed.orderBy(F.desc("promise")))
            frontier = broadcast_if_small(step.where("promise is not null").withColumn("n", first).where(F.col("n") <= beam * best).select(*start.columns))
    bound = union_levels(found).withColumn("n", F.row_number().over(by_seed.orderBy(F.desc("score")))).where(F.col("n") == best).select("seed", F.col("score").alias("bound"))
    frontier = broadcast_if_small(start.join(bound, "seed", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))))
    out = []
    for d in range(1, max_depth + 1):
        step = broadcast_if_small(level(frontier, d, "bound"))
        out.append(step.where(F.col("hit") & (F.col("score") >= F.col("bound"))).withColumn("depth", F.lit(d)))
        frontier = step.where(F.col("promise") >= F.col("bound")).drop("hit", "promise")
    return union_levels(out).select("seed", "at", "depth", "score", "nodes", "eids", "types")


def multi_seed_paths(g: PropertyGraph, seeds: DataFrame, target_types: list[str], edge_types: list[str] | None = None, max_depth: int = 2, direction: str = "out", max_paths_per_seed: int | None = 20, score: str = "product", weight: str = "weight", limit: int | None = None) -> DataFrame:
    """Paths from each seed to any node of `target_types`, going on through targets; the best so many of each seed
    (None: all), and of all: `seed`, `target`, `depth`, `score`, the path's columns."""
    targets, adj = g.node_index(target_types).select("gid"), steps_of(g, edge_types, direction, None, weight)
    if score == "product" and max_paths_per_seed:
        p = best_products(adj, seeds, targets, max_depth, max_paths_per_seed)
    else:
        p = simple_paths(adj, seeds, targets, max_depth).withColumn("score", path_score(F.col("weights"), score))
    by = [F.desc_nulls_last("score"), F.col("depth"), F.col("at"), F.col("eids")]
    if max_paths_per_seed is not None:
        p = p.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(*by))).where(F.col("n") <= max_paths_per_seed).drop("n")
    by = [F.desc_nulls_last("score"), F.col("depth"), F.col("seed"), F.col("at"), F.col("eids")]
    p = p.orderBy(*by)
    if limit is not None:
        p = p.limit(limit)
    return p.select("seed", F.col("at").alias("target"), "depth", "score", F.col("nodes").alias("path_node_ids"), F.col("eids").alias("path_edge_ids"), F.col("types").alias("path_edge_types"))


def shortest_path(g: PropertyGraph, source: int, target: int, edge_types: list[str] | None = None, max_depth: int | None = None, direction: str = "out", edge_filters: dict | None = None) -> DataFrame:
    """The least path by (depth, nodes, edges): one row, or none if the target can't be reached.

    Per level and node only the least path is kept, as any least path begins with one; the search ends at the target.
    """
    steps, known, d = steps_of(g, edge_types, direction, edge_filters), Kept(g.spark), 0
    start = g.spark.createDataFrame([(source, [source], [], 0)], "at bigint, nodes array<bigint>, eids array<bigint>, depth int")
    frontier, now = known.add(start), [source]
    while source != target and now != [] and (max_depth is None or d < max_depth):
        d += 1
        step = frontier.join(steps.of(now).select("node", "next", "eid"), F.col("at") == F.col("node"))
        step = step.select(F.col("next").alias("to"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("eids", F.array("eid")).alias("eids"))
        if d == max_depth:
            step = step.where(F.col("to") == target)
        best = step.groupBy(F.col("to").alias("at")).agg(F.min(F.struct("nodes", "eids")).alias("m")).select("at", "m.*", F.lit(d).alias("depth"))
        frontier = known.add(best.join(known.all().select("at"), "at", "left_anti"))
        now = few(frontier, "at")
        if target in now if now is not None else not frontier.where(F.col("at") == target).isEmpty():
            break
    return known.all().where((F.col("at") == target) & (F.col("depth") > 0))


def sample_layers(g: PropertyGraph, seeds: DataFrame, fanouts: list[int], edge_types: list[str], direction: str = "out", strategy: str = "uniform", seed: int = 0, replace: bool = False) -> DataFrame:
    """Layered neighbour sampling: `src`, `dst`, `edge_type`, `eid`, `layer` (from 0).

    In each layer, of every frontier node and relation `fanout` edges (0: all): the first by eid (`first`), or those
    with the least seeded hash (`uniform`), so the same seed gives the same sample. With `replace`, `fanout` draws
    that may repeat an edge, each the edge with the least hash of its own; all are found in one pass with partial
    results per task. The next frontier is the distinct ends reached. With a column `batch` (bigint) in `seeds`, each
    batch is sampled for itself, with `seed` plus its number, and the result has the column, too.
    """
    steps, known = steps_of(g, edge_types, direction), Kept(g.spark)
    by = ["batch"] if "batch" in seeds.columns else []
    now = keep(seeds.select("gid", *by).distinct())
    own = F.lit(seed).cast("bigint") + F.col("batch") if by else F.lit(seed).cast("bigint")
    for layer, fanout in enumerate(fanouts):
        nodes = few(now, "gid")
        j = now.join(steps.of(nodes).select("node", "next", "edge_type", "eid"), F.col("gid") == F.col("node")).drop("gid")
        draw = lambda *more: F.xxhash64(own, F.lit(layer), "eid", "next", *more)  # noqa: B023, E731
        if fanout and strategy != "all":
            if replace:
                picks = [F.min_by(F.struct("eid", "next"), F.struct(draw(F.lit(k)), "eid", "next")).alias(f"x{k}") for k in range(fanout)]
                j = j.groupBy(*by, "node", "edge_type").agg(*picks).select(*by, "node", "edge_type", F.explode(F.array(*[f"x{k}" for k in range(fanout)])).alias("x")).select(*by, "node", "x.next", "edge_type", "x.eid")
            else:
                order = [F.col("eid")] if strategy == "first" else [draw(), F.col("eid")]
                j = j.withColumn("n", F.row_number().over(Window.partitionBy(*by, "node", "edge_type").orderBy(*order))).where(F.col("n") <= fanout).drop("n")
        got = known.add(j.select(F.col("node").alias("src"), F.col("next").alias("dst"), "edge_type", "eid", F.lit(layer).alias("layer"), *by))
        now = got.select(F.col("dst").alias("gid"), *by).distinct()
    return known.all()


def random_walks(g: PropertyGraph, seeds: DataFrame, length: int, num_walks: int, edge_types: list[str] | None = None, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """`walk_id`, `step`, `gid`: `num_walks` walks of up to `length` steps from each seed; one ends where no edge leads on.

    Each step takes an out edge with probability in proportion to 1/p back to the node before, 1 to a neighbour of
    that node, 1/q elsewhere. The edge is the one with the greatest seeded -log(u)-style race value, computed in
    parallel for all candidates, so walks depend on the seed only.
    """
    steps = steps_of(g, edge_types).all().select("node", "next", "eid")
    known = Kept(g.spark)
    walks = seeds.select("gid").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
    now = known.add(walks.select(F.concat_ws(":", "gid", "k").alias("walk_id"), F.lit(0).alias("step"), "gid", F.lit(None).cast("bigint").alias("prev")))
    near = steps.select(F.col("node").alias("a"), F.col("next").alias("b")).distinct()
    for s in range(1, length + 1):
        j = now.drop("step").join(steps, F.col("gid") == F.col("node"))
        weight = F.lit(1.0)
        if (p, q) != (1.0, 1.0):
            j = j.join(near, (F.col("prev") == F.col("a")) & (F.col("next") == F.col("b")), "left")
            weight = F.when(F.col("prev").isNull(), 1.0).when(F.col("next") == F.col("prev"), 1 / p).when(F.col("a").isNotNull(), 1.0).otherwise(1 / q)
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "walk_id", "eid", "next"), F.lit(2**52)) + 1) / F.lit(float(2**52 + 1))
        race = -F.log(u) / weight
        best = j.groupBy("walk_id", "gid").agg(F.min_by(F.col("next"), F.struct(race, "eid", "next")).alias("to"))
        now = known.add(best.select("walk_id", F.lit(s).alias("step"), F.col("to").alias("gid"), F.col("gid").alias("prev")))
    return known.all().drop("prev")
