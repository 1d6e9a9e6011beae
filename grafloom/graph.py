"""A property graph: one DataFrame per class and per relation, and what is derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafloom.catalog import Catalog
from grafloom.errors import GraphError
from grafloom.plans.runtime import among

CREATED, DELETED = "_created_lsn", "_deleted_lsn"
#: Suffixes of edge filters, and what they compare.
_COMPARE = {"_gte": "__ge__", "_lte": "__le__", "_gt": "__gt__", "_lt": "__lt__", "_eq": "__eq__"}


def visible(df: DataFrame, lsn: int | None) -> DataFrame:
    """The versions visible at `lsn` (None: those not deleted); tables without these columns are visible always."""
    if CREATED not in df.columns:
        return df
    if lsn is None:
        return df.where(F.col(DELETED).isNull())
    return df.where((F.col(CREATED) <= lsn) & (F.col(DELETED).isNull() | (F.col(DELETED) > lsn)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class PropertyGraph:
    """Nodes: `gid` (bigint, unique in the graph), `node_id` (string) and properties. Edges: `eid`, `src`, `dst` (gids)
    and properties. Both may have `_created_lsn` and `_deleted_lsn`; a graph shows what is visible at its `lsn`.

    Where all classes (or relations) are stored in one table, `all_nodes` with `node_type` (`all_edges` with
    `edge_type`) gives the same rows as `nodes` (`edges`), so that what looks at several of them is one scan."""

    def __init__(
        self, spark: SparkSession, nodes: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame] | None = None, catalog: Catalog | None = None, lsn: int | None = None, snapshots: dict[str, int] | None = None,
        all_nodes: DataFrame | None = None, all_edges: DataFrame | None = None,
    ) -> None:
        self.spark, self.lsn = spark, lsn
        self.all_nodes, self.all_edges = all_nodes, all_edges
        self.stored_nodes, self.stored_edges = dict(nodes or {}), dict(edges or {})
        self.catalog = catalog or Catalog()
        self.snapshots = dict(snapshots or {})
        for name in self.stored_nodes:
            if name not in self.catalog.classes:
                self.catalog.define_class(name)
        for name in self.stored_edges:
            if name not in self.catalog.properties:
                self.catalog.define_property(name)

    # --- versions

    def at(self, snapshot: str | int) -> PropertyGraph:
        """The graph as it was at an lsn or a named snapshot."""
        if isinstance(snapshot, str):
            if snapshot not in self.snapshots:
                raise GraphError(8013, f"no snapshot {snapshot!r}")
            snapshot = self.snapshots[snapshot]
        return PropertyGraph(self.spark, self.stored_nodes, self.stored_edges, self.catalog, snapshot, self.snapshots, self.all_nodes, self.all_edges)

    def create_snapshot(self, name: str, lsn: int | None = None) -> int:
        """Names an lsn, by default the greatest one in use."""
        if name in self.snapshots:
            raise GraphError(8012, f"snapshot {name!r} exists")
        self.snapshots[name] = lsn if lsn is not None else self.last_lsn()
        return self.snapshots[name]

    def release_snapshot(self, name: str) -> None:
        if self.snapshots.pop(name, None) is None:
            raise GraphError(8013, f"no snapshot {name!r}")

    def last_lsn(self) -> int:
        used = [df.select(F.greatest(F.max(CREATED), F.max(DELETED))) for df in [*self.stored_nodes.values(), *self.stored_edges.values()] if CREATED in df.columns]
        return (union_all([u.toDF("m") for u in used]).agg(F.max("m")).first()[0] or 0) if used else 0

    # --- tables

    def nodes(self, name: str) -> DataFrame:
        """Rows of one class."""
        cls = self.catalog.find(name).name
        if cls not in self.stored_nodes:
            raise GraphError(7012, f"class {name} has no nodes")
        return visible(self.stored_nodes[cls], self.lsn)

    def edges(self, name: str) -> DataFrame:
        if name not in self.stored_edges:
            raise GraphError(6023, f"unknown relation {name}")
        return visible(self.stored_edges[name], self.lsn)

    def node_index(self, classes: list[str] | None = None) -> DataFrame:
        """`gid`, `node_id`, `node_type` of all nodes."""
        names = [self.catalog.find(c).name for c in classes] if classes else list(self.stored_nodes)
        id_of = lambda df: (F.col("node_id").cast("string") if "node_id" in df.columns else F.col("gid").cast("string")).alias("node_id")
        if self.all_nodes is not None and len(names) > 1:
            return visible(self.all_nodes.where(F.col("node_type").isin(names)), self.lsn).select("gid", id_of(self.all_nodes), "node_type")
        if not names:
            return self.spark.createDataFrame([], "gid bigint, node_id string, node_type string")
        return union_all([self.nodes(n).select("gid", id_of(self.stored_nodes[n]), F.lit(n).alias("node_type")) for n in names])

    def named(self, rows: DataFrame, column: str, gids: list[int] | None = None) -> DataFrame:
        """`rows` with `node_id` and `node_type` of the node in `column`, null if it is unknown. `gids`: the values of
        the column, where they are known to be few; then only these nodes are looked up."""
        index = self.node_index()
        if gids is not None:
            index = index.where(among("gid", gids))
        return rows.join(index.withColumnRenamed("gid", "gid_i"), F.col(column) == F.col("gid_i"), "left").drop("gid_i")

    def closure(self, base: str, include_self: bool = True) -> DataFrame:
        """Rows of a class and all below it: the columns that all of them have, in the first one's order, and
        `class_iri`. Classes without nodes are skipped."""
        names = [n for n in self.catalog.descendants(base, include_self) if n in self.stored_nodes]
        if not names:
            raise GraphError(7012, f"no class below {base} has nodes")
        frames = [self.nodes(n) for n in names]
        common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        return union_all([f.select(*common, F.lit(self.catalog.classes[n].iri).alias("class_iri")) for n, f in zip(names, frames, strict=True)])

    def resolve(self, refs: list) -> DataFrame:
        """`pos`, `gid` of node references: an external id, or else a number that is a gid. An unknown one is an error."""
        given = self.spark.createDataFrame([(i, str(getattr(r, "external_id", r))) for i, r in enumerate(refs)], "pos bigint, ref string")
        known = self.node_index()
        found = F.broadcast(given).join(known, F.col("ref") == F.col("node_id")).select("pos", "gid").collect()
        gids = {r["pos"]: r["gid"] for r in found}
        for i, r in enumerate(refs):
            if i not in gids:
                if not (isinstance(r, int) and r >= 0):
                    raise GraphError(7021, f"unknown node {r!r}")
                gids[i] = r
        return self.spark.createDataFrame(sorted(gids.items()), "pos bigint, gid bigint")

    # --- adjacency

    def adjacency(
        self, edge_types: list[str] | None = None, direction: str = "out", filters: dict | None = None, weight: str = "weight", top_per_node: int | None = None, only: list[int] | None = None, properties: bool = True,
    ) -> DataFrame:
        """Steps `node` -> `next` along relations: `edge_type`, `eid`, `src`, `dst`, `direction`, `w`, `properties`.

        Relations that don't exist are left out. `both` takes each edge in either direction, a loop twice. `filters`:
        edge columns with a suffix `_eq`, `_gte`, `_lte`, `_gt`, `_lt`, or none for equality. Missing weights are 0.
        `top_per_node` keeps the first so many steps of a node in order of weight descending, type, eid, next. `only`:
        the steps from these nodes, a filter that goes down into the scan. Without `properties` that column is left out.
        """
        if direction not in ("out", "in", "both"):
            raise GraphError(6020, f"invalid direction {direction!r}")
        names = [n for n in (sorted(self.stored_edges) if edge_types is None else dict.fromkeys(edge_types)) if n in self.stored_edges]
        if self.all_edges is not None and len(names) > 1:
            tables = [visible(self.all_edges.where(F.col("edge_type").isin(names)), self.lsn)]
        else:
            tables = [self.edges(n).withColumn("edge_type", F.lit(n)) for n in names]
        parts = []
        for e in tables:
            for f, value in (filters or {}).items():
                e = e.where(_edge_filter(e, f, value))
            ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
            if only is not None:
                e = e.where(reduce(lambda a, b: a | b, [among(x, only) for x in ends]))
            props = sorted(c for c in e.columns if c not in ("eid", "src", "dst", "edge_type", CREATED, DELETED)) if properties else []
            w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight in e.columns else F.lit(0.0)
            json = F.to_json(F.struct(*props), {"ignoreNullFields": "false"}) if props else F.lit("{}")
            step = e.select("edge_type", "eid", "src", "dst", w.alias("w"), *([json.alias("properties")] if properties else []))
            ways = {"out": [("src", "dst", "out")], "in": [("dst", "src", "in")], "both": [("src", "dst", "out"), ("dst", "src", "in")]}[direction]
            if len(ways) == 1:
                node, next_, way = ways[0]
                parts.append(step.select(F.col(node).alias("node"), F.col(next_).alias("next"), "*", F.lit(way).alias("direction")))
            else:  # both ways from one scan
                both = F.array(*[F.struct(F.col(n).alias("node"), F.col(x).alias("next"), F.lit(w).alias("direction")) for n, x, w in ways])
                parts.append(step.select("*", F.inline(both)).select("node", "next", *step.columns, "direction"))
        if not parts:
            return self.spark.createDataFrame([], f"node bigint, next bigint, edge_type string, eid bigint, src bigint, dst bigint, w double, {'properties string, ' if properties else ''}direction string")
        out = union_all(parts).where("node is not null and next is not null")
        if only is not None and direction == "both":
            out = out.where(among("node", only))
        return out if top_per_node is None else first_steps(out, top_per_node)


def first_steps(steps: DataFrame, n: int) -> DataFrame:
    """Of each node the first `n` steps in order of weight descending, type, eid, next."""
    order = Window.partitionBy("node").orderBy(F.desc("w"), "edge_type", "eid", "next")
    return steps.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= n).drop("n_")


def _edge_filter(e: DataFrame, name: str, value) -> Column:  # noqa: ANN001
    for suffix, method in _COMPARE.items():
        column = name.removesuffix(suffix)
        if column != name and column in e.columns:
            return getattr(F.col(column), method)(value)
    return F.col(name) == value if name in e.columns else F.lit(False)
