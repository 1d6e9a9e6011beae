"""Queries of the graph operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.functions import builtins as fn
from grafloom.operators import algebra, ontology, retrieve, text, traverse, vector
from grafloom.operators.features import FeatureView
from grafloom.plans.runtime import table
from grafloom.queries.world import BASE, PLACE, sales_graph, store_graph
from grafloom.sources import export
from grafloom.streaming.ingest import windowed

S = SparkSession
#: Seeds of the traversals in the graph store, and its relations of knowledge.
SEEDS = (4, 7, 19, 18)
KNOWLEDGE = ["MENTIONS", "RELATED_TO", "EVIDENCED_BY"]
#: Two accounts, three transfers apart in the middle table.
ACCOUNTS = (9, 1081)
QUERY_VECTOR_ID = 7
#: Least mean recall of the search through the inverted file.
RECALL = 0.9


def _seeds(spark: S, gids=SEEDS) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(list(enumerate(gids)), "pos bigint, gid bigint")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- joins, aggregates, sorting


def join_inner(spark: S, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return algebra.hash_join(c, table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey")


def join_probe_outer(spark: S, sf: str) -> DataFrame:
    nodes = table(spark, sf, "node_store").where("_deleted_lsn is null").select("nid", "node_type").distinct()
    edges = table(spark, sf, "edge_store").where("_deleted_lsn is null").select("eid", "src").distinct()
    return algebra.hash_join(nodes, edges, "nid", "src", "left")


def join_null_safe(spark: S, sf: str) -> DataFrame:
    per = table(spark, sf, "node_store").groupBy("document_id").agg(F.count_distinct("nid").alias("nodes"))
    hits = table(spark, sf, "graphrag_result").groupBy("document_id").agg(F.count_distinct("result_id").alias("hits"))
    return algebra.hash_join(per, hits, "document_id", "document_id", probe_prefix="hit_")


def agg_all_kernels(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kernels = [("value", "count", "n_value"), (None, "count_star", "n"), ("value", "sum", "sum_value"), ("value", "min", "min_value"), ("value", "max", "max_value"), ("value", "mean", "mean_value"), ("value", "stddev", "sd_value"), ("value", "percentile:0.5", "median_value"), ("user_id", "count_distinct", "users")]
    return _round(algebra.hash_aggregate(e, ["event_type"], kernels), "sum_value", "mean_value", "sd_value", "median_value")


def agg_global(spark: S, sf: str) -> DataFrame:
    g = table(spark, sf, "graphrag_result")
    return algebra.hash_aggregate(g, [], [(None, "count_star", "n"), ("depth", "count", "with_depth"), ("depth", "max", "max_depth"), ("search_id", "count_distinct", "searches")])


def agg_collect(spark: S, sf: str) -> DataFrame:
    n = table(spark, sf, "node_store").select("node_type", "entity_type").distinct()
    return algebra.hash_aggregate(n, ["node_type"], [("entity_type", "collect", "kinds")]).withColumn("kinds", F.array_sort("kinds"))


def topk_sorted(spark: S, sf: str) -> DataFrame:
    g = table(spark, sf, "graphrag_result").select("result_id", "score", "depth")
    return algebra.top_k(g, [("score", True), ("depth", False), ("result_id", False)], limit=100, offset=10)


def union_all_drop_rename(spark: S, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_nationkey").alias("nation"))
    return algebra.drop_trailing(algebra.union_frames([a, b]), ["nation"])


def expression_filter(spark: S, sf: str) -> DataFrame:
    e = ("and", ("gt", ("col", "p_size"), ("lit", 10)), ("or", ("in", ("col", "p_brand"), ["Brand#11", "Brand#22", "Brand#33"]), ("not", ("lt", ("col", "p_retailprice"), ("lit", 1200.0)))))
    return table(spark, sf, "part").where(algebra.compile_expr(e)).select("p_partkey", "p_brand", "p_size")


# --- graph basics


def degree_out(spark: S, sf: str) -> DataFrame:
    return traverse.degree(store_graph(spark, sf), "MENTIONS")


def degree_in(spark: S, sf: str) -> DataFrame:
    return traverse.degree(store_graph(spark, sf), "MENTIONS", "in")


def degree_both_with_zero(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    return traverse.degree(g, "transferredTo", "both", g.nodes("Account"))


def adjacent_edges(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    return traverse.out_edges(g, g.nodes("Gene"), "interactsWith").withColumn("end", F.lit("out")).unionByName(traverse.out_edges(g, g.nodes("Tissue"), "expressedIn", incoming=True).withColumn("end", F.lit("in")))


def common_neighbors(spark: S, sf: str) -> DataFrame:
    return traverse.common_neighbors(store_graph(spark, sf), 1, 2, "MENTIONS")


def overlap_topk(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    return traverse.overlap(g, 1, g.nodes("Chunk"), "MENTIONS", top_k=50)


def top_edges_per_node(spark: S, sf: str) -> DataFrame:
    return store_graph(spark, sf).adjacency(KNOWLEDGE, "both", top_per_node=3).select("node", "next", "edge_type", "eid", "direction", "w")


def edge_filters(spark: S, sf: str) -> DataFrame:
    return store_graph(spark, sf).adjacency(["SEMANTIC_NEIGHBOR", "no_such"], "out", {"weight_gte": 0.5, "weight_lt": 0.9, "metric": "cosine"}).select("node", "next", "eid")


# --- traversals


def neighbors_bfs(spark: S, sf: str) -> DataFrame:
    r = traverse.neighbors(store_graph(spark, sf), _seeds(spark), KNOWLEDGE, depth=2)
    return r.select("node_id", "node_type", "internal_id", "depth", "via_edge_id", "via_edge_type")


def neighbors_scored(spark: S, sf: str) -> DataFrame:
    r = traverse.neighbors(store_graph(spark, sf), _seeds(spark), KNOWLEDGE, "both", 2, limit=100, node_types=["Chunk"], top_edges_per_node=5, score="product", order_by_score="desc")
    return _round(r.select("internal_id", "depth", "path_score"), "path_score")


def k_hop_nodes(spark: S, sf: str) -> DataFrame:
    return traverse.k_hop(store_graph(spark, sf), _seeds(spark), 2, ["interactsWith", "expressedIn"], "both", None, None)[0].select("internal_id", "depth")


def k_hop_edges(spark: S, sf: str) -> DataFrame:
    return traverse.k_hop(store_graph(spark, sf), _seeds(spark), 2, ["interactsWith", "expressedIn"], "both", None, None)[1]


def reachability(spark: S, sf: str) -> DataFrame:
    g = sales_graph(spark, sf)
    return traverse.reachable(g.adjacency(["IN_NATION", "IN_REGION"]), g.nodes("Customer"), 0, 3)


def reachable_per_depth(spark: S, sf: str) -> DataFrame:
    return traverse.reachable_per_depth(traverse.steps_of(store_graph(spark, sf), KNOWLEDGE), _seeds(spark), 2)


def simple_paths_scored(spark: S, sf: str) -> DataFrame:
    r = traverse.paths(store_graph(spark, sf), 1, 13, ["MENTIONS", "RELATED_TO"], max_depth=2, limit=50, score="sum")
    return _round(r.select("depth", "internal_node_ids", "edge_ids", "path_score"), "path_score")


def multi_seed_paths(spark: S, sf: str) -> DataFrame:
    r = traverse.multi_seed_paths(store_graph(spark, sf), _seeds(spark), ["Chunk"], KNOWLEDGE, max_depth=2, max_paths_per_seed=10)
    return _round(r.select("seed", "target", "depth", "score", "path_edge_ids"), "score")


def path_scores(spark: S, sf: str) -> DataFrame:
    """The best path by each of the other scores, between two accounts."""
    g, out = store_graph(spark, sf), []
    for mode in ("average", "min", "max"):
        r = traverse.paths(g, *ACCOUNTS, ["transferredTo"], max_depth=3, limit=5, score=mode)
        out.append(r.select(F.lit(mode).alias("mode"), "depth", "internal_node_ids", "edge_ids", "path_score"))
    return _round(traverse.union_levels(out), "path_score")


def shortest_path_deep(spark: S, sf: str) -> DataFrame:
    return traverse.shortest_path(store_graph(spark, sf), *ACCOUNTS, ["transferredTo"], max_depth=3).select("depth", "nodes", "eids")


def neighbors_of_class(spark: S, sf: str) -> DataFrame:
    """From all chunks at once: what they mention, and what is related to that."""
    g = store_graph(spark, sf)
    r = traverse.neighbors(g, g.nodes("Chunk").select(F.col("gid").alias("pos"), "gid"), ["MENTIONS", "RELATED_TO"], depth=2)
    return r.select("node_id", "internal_id", "depth")


def shortest_path(spark: S, sf: str) -> DataFrame:
    return traverse.shortest_path(store_graph(spark, sf), 7, 13, KNOWLEDGE, max_depth=3, direction="both").select("depth", "nodes", "eids")


def sample_first(spark: S, sf: str) -> DataFrame:
    return traverse.sample_layers(store_graph(spark, sf), _seeds(spark), [4, 2], KNOWLEDGE, "both", strategy="first")


def sample_uniform(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    return traverse.sample_layers(g, g.nodes("Entity"), [5, 3], KNOWLEDGE, "out", seed=11)


def random_walks(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    return traverse.random_walks(g, g.nodes("Gene"), 3, 2, ["interactsWith", "expressedIn"], p=0.5, q=2.0, seed=3)


# --- ontology, triples


def closure_scan(spark: S, sf: str) -> DataFrame:
    return sales_graph(spark, sf).closure("Place")


def closure_pairs(spark: S, sf: str) -> DataFrame:
    return ontology.closure_table(sales_graph(spark, sf))


def infer_symmetric(spark: S, sf: str) -> DataFrame:
    return ontology.symmetric_edges(store_graph(spark, sf).edges("interactsWith"))


def infer_transitive(spark: S, sf: str) -> DataFrame:
    g = sales_graph(spark, sf)
    return ontology.transitive_edges(g.edges("IN_NATION").select("src", "dst").unionByName(g.edges("IN_REGION").select("src", "dst")))[0]


def triple_constant(spark: S, sf: str) -> DataFrame:
    return algebra.triple_scan(store_graph(spark, sf).edges("RELATED_TO"), 5, "?o")


def triple_pattern_join(spark: S, sf: str) -> DataFrame:
    g = sales_graph(spark, sf)
    region = PLACE["Region"] * BASE + 1
    return algebra.basic_graph_pattern({r: g.edges(r) for r in ("IN_NATION", "IN_REGION", "PLACED")}, [("?n", "IN_REGION", region), ("?c", "IN_NATION", "?n"), ("?c", "PLACED", "?o")])


# --- vectors


def _query(spark: S, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == QUERY_VECTOR_ID).first()["embedding"]]


def _knn(metric: str, label: int | None = None):  # noqa: ANN202
    def run(spark: S, sf: str) -> DataFrame:
        e = table(spark, sf, "embeddings")
        r = vector.knn(e, "vec_id", "embedding", _query(spark, sf), 10, metric, None if label is None else F.col("label") == label)
        return _round(r, "score", "distance")

    return run


def vector_functions(spark: S, sf: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query(spark, sf)])
    v = F.col("embedding")
    names = ("similarity", "cosine_similarity", "cosine_distance", "dot_product", "l2_distance")
    return _round(table(spark, sf, "embeddings").select("vec_id", *[fn.call(n, [v, q]).alias(n) for n in names], fn.call("vec_norm", [v]).alias("vec_norm"), fn.norm(fn.call("vec_normalize", [v])).alias("unit")), *names, "vec_norm", "unit")


def knn_join(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    r = vector.knn_join(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return _round(r, "score")


def _knn_join(metric: str, label: int | None = None):  # noqa: ANN202
    """The stated query set against all rows, or those of one label."""

    def run(spark: S, sf: str) -> DataFrame:
        e = table(spark, sf, "embeddings")
        r = vector.knn_join(e if label is None else e.where(F.col("label") == label), e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, metric)
        return _round(r, "score")

    return run


def ivf_search(spark: S, sf: str) -> DataFrame:
    """The stated query set through the index, with as many lists as a measured recall of `RECALL` takes."""
    e = table(spark, sf, "embeddings")
    queries, index = e.where("vec_id % 100 = 0"), vector.InvertedFile(e, "vec_id", "embedding")
    return _round(index.search_join(queries, 10, index.probes_for(RECALL, 10, queries)), "score")


def ivf_recall(spark: S, sf: str) -> DataFrame:
    """Whether the stated queries find at least `RECALL` of their nearest rows through the index."""
    exact, found = knn_join(spark, sf).select("query", "id"), ivf_search(spark, sf).select("query", "id")
    hit = exact.join(found.withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) >= RECALL * F.count("*")).alias("enough"), F.count("*").alias("pairs"))


# --- text, retrieval


def _entries(g) -> DataFrame:  # noqa: ANN001
    return text.text_entries(g.nodes("Entity"), ["canonical_name", "aliases"])


NAME = "ravudo xapika"


def text_search(spark: S, sf: str) -> DataFrame:
    return _round(text.text_search(_entries(store_graph(spark, sf)), NAME, 20), "score")


def token_index(spark: S, sf: str) -> DataFrame:
    return text.token_index(_entries(store_graph(spark, sf)))


def link_entities(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    return _round(retrieve.link_entities(g, NAME, _entries(g), 5), "score", "lexical_score", "semantic_score", "graph_prior_score")


def evidence_search(spark: S, sf: str) -> DataFrame:
    seeds = _seeds(spark).withColumn("seed_score", F.lit(1.0) / (F.col("pos") + 1))
    r = retrieve.evidence_search(store_graph(spark, sf), seeds, edge_types=KNOWLEDGE, top_edges_per_node=24)
    return _round(r.select("target", "seed", "score", "rank", "depth", "path_score", "path_edge_ids"), "score", "path_score")


def _chunk_vectors(spark: S, sf: str, g) -> DataFrame:  # noqa: ANN001
    """Chunks with the embedding of vec_id gid, where there is one."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("gid"), "embedding")
    return g.nodes("Chunk").join(e, "gid", "left")


def vector_search_boosted(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    boosts = [{"signal": "degree", "weight": 0.001}, {"signal": "edge_weight_sum", "weight": 0.01}, {"signal": "mentions_entity", "weight": 0.25, "entities": [7, 19]}]
    r = vector.vector_search(_chunk_vectors(spark, sf, g), "embedding", _query(spark, sf), 10, boosts=boosts, adjacency=lambda gids: g.adjacency(KNOWLEDGE, "both", only=gids, properties=False))
    return _round(r.select("gid", "node_id", "score", "vector_score", "graph_boost_score", "rank"), "score", "vector_score", "graph_boost_score")


def graphrag(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    r = retrieve.graphrag_search(g, NAME, _entries(g), (_chunk_vectors(spark, sf, g), "embedding", _query(spark, sf)), edge_types=KNOWLEDGE)
    return _round(r.evidence_chunks, "score", "evidence", "semantic")


# --- versions


def as_of_nodes(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    g.create_snapshot("early", 50_000)
    old = g.at("early")
    return old.node_index().groupBy("node_type").agg(F.count("*").alias("nodes"))


def as_of_edges(spark: S, sf: str) -> DataFrame:
    return store_graph(spark, sf).at(20_000).adjacency(["RELATED_TO"]).select("eid", "node", "next")


def bundle_diff(spark: S, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    return export.diff(g.at(60_000), g.at(120_000))


def feature_lookup(spark: S, sf: str) -> DataFrame:
    """Degrees as features of every target that a search found."""
    g = store_graph(spark, sf)
    view = FeatureView(traverse.degree(g, "MENTIONS", "in"))
    ids = table(spark, sf, "graphrag_result").select(F.regexp_extract("target_node_id", "([0-9]+)$", 1).try_cast("bigint").alias("gid")).where("gid is not null").distinct()
    return view.join(ids)


def event_windows(spark: S, sf: str) -> DataFrame:
    return _round(windowed(table(spark, sf, "events"), "ts", "event_type", "value", "1 hour"), "total")


QUERIES = {
    f.__name__: f
    for f in (
        join_inner, join_probe_outer, join_null_safe, agg_all_kernels, agg_global, agg_collect, topk_sorted, union_all_drop_rename, expression_filter, degree_out, degree_in, degree_both_with_zero, adjacent_edges,
        common_neighbors, overlap_topk, top_edges_per_node, edge_filters, neighbors_bfs, neighbors_scored, k_hop_nodes, k_hop_edges, reachability, reachable_per_depth, simple_paths_scored, multi_seed_paths, path_scores, shortest_path, shortest_path_deep, neighbors_of_class,
        sample_first, sample_uniform, random_walks, closure_scan, closure_pairs, infer_symmetric, infer_transitive, triple_constant, triple_pattern_join, vector_functions, knn_join, ivf_search, ivf_recall, text_search, token_index,
        link_entities, evidence_search, vector_search_boosted, graphrag, as_of_nodes, as_of_edges, bundle_diff, feature_lookup, event_windows,
    )
} | {"knn_cosine": _knn("cosine"), "knn_l2": _knn("l2"), "knn_dot": _knn("dot"), "knn_filtered": _knn("cosine", 3), "knn_join_l2": _knn_join("l2"), "knn_join_dot": _knn_join("dot"), "knn_join_filtered": _knn_join("cosine", 3)}
