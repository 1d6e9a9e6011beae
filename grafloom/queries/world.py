"""The driver's tables as property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafloom.catalog import Catalog
from grafloom.graph import PropertyGraph
from grafloom.plans.runtime import table

#: Classes of the sales graph in order; a node's gid is its place times 10^10 plus its key.
PLACE = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6}
BASE = 10_000_000_000
_TABLES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}
NODE_TYPES = ("Chunk", "Entity", "Gene", "Tissue", "User", "Item", "Account")
EDGE_TYPES = ("MENTIONS", "RELATED_TO", "EVIDENCED_BY", "SEMANTIC_NEIGHBOR", "interactsWith", "expressedIn", "transferredTo")


def _gid(cls: str, key: str) -> F.Column:
    return (F.lit(PLACE[cls] * BASE) + F.col(key)).cast("bigint")


def sales_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    t = lambda n: table(spark, sf, n)
    nodes = {c: t(n).withColumns({"gid": _gid(c, k), "node_id": F.concat(F.lit(c.lower() + "/"), F.col(k).cast("string"))}) for c, (n, k) in _TABLES.items()}

    def relation(df: DataFrame, a: tuple[str, str], b: tuple[str, str], eid: F.Column, *props: str) -> DataFrame:
        return df.select(eid.cast("bigint").alias("eid"), _gid(*a).alias("src"), _gid(*b).alias("dst"), *props)

    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    edges = {
        "IN_REGION": relation(t("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), F.col("n_nationkey")),
        "IN_NATION": relation(t("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), F.col("c_custkey")).unionByName(relation(t("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), -F.col("s_suppkey") - 1)),
        "PLACED": relation(t("orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), F.col("o_orderkey")),
        "CONTAINS": relation(t("lineitem"), ("Order", "l_orderkey"), ("Part", "l_partkey"), line, "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"),
        "SHIPPED_BY": relation(t("lineitem"), ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), line, "l_quantity"),
    }
    catalog = Catalog()
    catalog.define_class("Agent")
    catalog.define_class("Place")
    for c in PLACE:
        catalog.define_class(c, parents={"Customer": ["Agent"], "Supplier": ["Agent"], "Nation": ["Place"], "Region": ["Place"]}.get(c, []))
    return PropertyGraph(spark, nodes, edges, catalog)


def chain_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    """The nations one after the other, in order of key: a path as long as there are nations."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("gid"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("node_id"), "n_nationkey")
    steps = n.select(F.col("gid").alias("src"), F.lead("gid").over(Window.orderBy("gid")).alias("dst"), F.row_number().over(Window.orderBy("gid")).cast("bigint").alias("eid"))  # 25 rows
    return PropertyGraph(spark, {"Nation": n}, {"NEXT": steps.where("dst is not null")})


def overlapping_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    """Customers in two classes that have some in common, by the same gid."""
    c = table(spark, sf, "customer").withColumns({"gid": F.col("c_custkey").cast("bigint"), "node_id": F.col("c_custkey").cast("string")})
    return PropertyGraph(spark, {"Builder": c.where("c_mktsegment = 'BUILDING'"), "Rich": c.where("c_acctbal > 5000")})


def store_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    """The versioned graph store: one row per version and per edge, repeated rows once; NaN weights are null.

    The rows of an eid differ in `ingested_at` only, so grouping by all other columns makes edges single, and filters
    on any of them go below that into the scan."""
    n = table(spark, sf, "node_store").withColumnsRenamed({"nid": "gid"})
    rest = [c for c in n.columns if c not in ("gid", "_created_lsn", "node_type")]
    version = lambda df: df.groupBy("gid", "_created_lsn", "node_type").agg(*[F.max(c).alias(c) for c in rest])
    e = table(spark, sf, "edge_store").withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))
    one = lambda df: df.select("eid", "src", "dst", "weight", "metric", "index_name", "_created_lsn", "_deleted_lsn", "edge_type").distinct()
    catalog = Catalog()
    catalog.define_class("Molecular")
    for c in NODE_TYPES:
        catalog.define_class(c, parents=["Molecular"] if c in ("Gene", "Tissue") else [])
    nodes = {t: version(n.where(F.col("node_type") == t)) for t in NODE_TYPES}
    edges = {t: one(e.where(F.col("edge_type") == t)).drop("edge_type") for t in EDGE_TYPES}
    return PropertyGraph(spark, nodes, edges, catalog, all_nodes=version(n), all_edges=one(e))


#: SQL of the graph store's current nodes and edges.
STORE_SQL = """
nodes as (select nid gid, max(node_id) node_id, max(node_type) node_type, max(canonical_name) canonical_name, max(aliases) aliases, max(entity_type) entity_type, max(document_id) document_id
          from node_store where _deleted_lsn is null group by nid, _created_lsn),
edges as (select eid, max(edge_type) edge_type, max(src) src, max(dst) dst, max(case when not isnan(weight) then weight end) :: double weight from edge_store group by eid having max(_deleted_lsn) is null)
"""
