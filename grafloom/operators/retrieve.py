"""Retrieval for question answering: entity linking, evidence along paths, and both together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafloom.functions.prefix import running_before
from grafloom.graph import PropertyGraph
from grafloom.operators.text import text_search
from grafloom.operators.traverse import path_score, simple_paths, steps_of
from grafloom.operators.vector import vector_search
from grafloom.plans.runtime import few, keep

LINK_WEIGHTS = {"exact_phrase": 1.0, "canonical_phrase": 1.0, "alias_phrase": 0.9, "token_overlap": 0.45, "semantic": 0.35, "degree_prior": 0.05, "evidence_chunk_prior": 0.15}
EVIDENCE_WEIGHTS = {"path_weight": 0.55, "seed_score": 0.30, "depth_penalty": 0.15}


def link_entities(g: PropertyGraph, query: str, entries: DataFrame | None, top_k: int = 5, policies: dict | None = None, vectors: tuple[DataFrame, str, list[float]] | None = None, chunk_type: str = "Chunk") -> DataFrame:
    """Entities that a text names: `gid`, `score`, `lexical_score`, `semantic_score`, `graph_prior_score`, `kind`,
    `text`, `rank`.

    `entries` are texts of nodes, or those of them that share a token with the query (None: no texts). Text hits are
    weighted by kind and property (canonical name, alias, other exact, rest); vector hits by
    `semantic`; priors are x / (1 + x) of the degree and of the number of distinct chunks next to the entity.
    """
    w = LINK_WEIGHTS | (policies or {})
    inner = max(4 * top_k, 16)
    if entries is None:
        entries = g.spark.createDataFrame([], "gid bigint, property string, pos int, text string, norm string, tokens array<string>")
    hits = text_search(entries, query, inner)
    full = F.col("kind").isin("exact", "normalized")
    weight = F.when(full & (F.col("property") == "canonical_name"), w["canonical_phrase"]).when(full & (F.col("property") == "aliases"), w["alias_phrase"]).when(full, w["exact_phrase"]).otherwise(w["token_overlap"])
    found = hits.select("gid", "kind", "text", (F.col("score") * weight).alias("lexical_score"))
    if vectors:
        rows, column, q = vectors
        near = vector_search(rows, column, q, inner).select("gid", (F.col("vector_score") * w["semantic"]).alias("semantic_score"))
        found = found.join(near, "gid", "full")
    else:
        found = found.withColumn("semantic_score", F.lit(0.0))
    found = keep(found)  # at most 2 * inner rows
    near = g.adjacency(None, "both", only=few(found, "gid"), properties=False).select(F.col("node").alias("gid"), "next")
    chunks = near.join(g.node_index([chunk_type]).select(F.col("gid").alias("c")), F.col("next") == F.col("c"), "left")
    prior = chunks.groupBy("gid").agg(F.count("*").alias("d"), F.count_distinct("c").alias("n"))
    bounded = lambda c: F.coalesce(F.col(c) / (1.0 + F.col(c)), F.lit(0.0))
    out = found.join(prior, "gid", "left").withColumn("graph_prior_score", w["degree_prior"] * bounded("d") + w["evidence_chunk_prior"] * bounded("n"))
    out = out.fillna(0.0, ["lexical_score", "semantic_score"]).withColumn("kind", F.coalesce("kind", F.lit("semantic")))
    out = out.withColumn("score", F.col("lexical_score") + F.col("semantic_score") + F.col("graph_prior_score"))
    order = [F.desc("score"), F.col("gid")]
    out = out.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return out.select("gid", "score", "rank", "kind", "text", "lexical_score", "semantic_score", "graph_prior_score")


def evidence_search(
    g: PropertyGraph, seeds: DataFrame, target_type: str = "Chunk", edge_types: list[str] | None = None, direction: str = "both", max_depth: int = 2, top_k: int | None = 36,
    max_paths_per_seed: int | None = 8, top_edges_per_node: int | None = 24, scoring: dict | None = None, weight: str = "weight",
) -> DataFrame:
    """The best path from any seed (`pos`, `gid`, `seed_score`) to each target: `target`, `seed`, `score`, `depth`,
    `path_score`, the path's columns and `rank`.

    Simple paths that end at the first node of the target type; score = 0.55 * product of weights + 0.30 * seed score
    - 0.15 * depth. Of each seed the best so many paths, of these the best per target, of these the first `top_k` (None:
    all, each time); ties by depth, target, seed, edges.
    """
    w = EVIDENCE_WEIGHTS | (scoring or {})
    targets = g.node_index([target_type]).select("gid")
    steps = steps_of(g, edge_types, direction, None, weight, top_edges_per_node)
    p = simple_paths(steps, seeds, targets, max_depth, stop=True, by_weight=top_edges_per_node is not None)
    p = p.join(seeds.select(F.col("gid").alias("seed"), "seed_score"), "seed").withColumn("path_score", path_score(F.col("weights"), "product"))
    p = p.withColumn("score", w["path_weight"] * F.col("path_score") + w["seed_score"] * F.col("seed_score") - w["depth_penalty"] * F.col("depth"))
    order = [F.desc("score"), F.col("depth"), F.col("at"), F.col("seed"), F.col("eids")]
    if max_paths_per_seed is not None:
        p = p.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).where(F.col("n") <= max_paths_per_seed)
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("at").orderBy(*order))).where("n = 1")
    if top_k is not None:
        p = p.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:  # ranks of any number of rows, block by block of scores
        p = p.withColumn("one", F.lit(1))
        p = running_before(keep(p), [], F.floor(-F.col("score") * 64), order, {"before": ("sum", "one")}).withColumn("rank", (F.coalesce("before", F.lit(0)) + 1).cast("int"))
    return p.select(F.col("at").alias("target"), "seed", "score", "rank", "depth", "path_score", F.col("nodes").alias("path_node_ids"), F.col("eids").alias("path_edge_ids"), F.col("types").alias("path_edge_types"))


@dataclass
class GraphRAGResult:
    entity_links: DataFrame
    semantic_hits: DataFrame
    evidence_chunks: DataFrame
    citation_candidates: DataFrame
    paths: DataFrame
    profile: dict


def graphrag_search(
    g: PropertyGraph, query: str, entries: DataFrame, vectors: tuple[DataFrame, str, list[float]], top_k: int = 8, edge_types: list[str] | None = None, direction: str = "out", max_depth: int = 2, scoring: dict | None = None,
) -> GraphRAGResult:
    """Links entities, searches chunks by vector with a boost for chunks next to them, follows evidence from both."""
    links = keep(link_entities(g, query, entries, top_k))
    entities = [r["gid"] for r in links.select("gid").collect()]  # top_k rows
    boosts = [{"signal": "mentions_entity", "entities": entities, "weight": (scoring or {}).get("entity_link", 0.25)}] if entities else None
    rows, column, q = vectors
    semantic = keep(vector_search(rows, column, q, top_k, boosts=boosts, adjacency=lambda gids: g.adjacency(None, "both", only=gids, properties=False), oversample=4))
    seeds = semantic.select("gid", F.col("score").alias("seed_score"), F.lit(0).alias("first")).unionByName(links.select("gid", F.col("score").alias("seed_score"), F.lit(1).alias("first")))
    seeds = seeds.groupBy("gid").agg(F.max_by("seed_score", "first").alias("seed_score"))  # an entity's score goes first
    seeds = keep(seeds.withColumn("pos", F.col("gid")))
    evidence = keep(evidence_search(g, seeds, edge_types=edge_types, direction=direction, max_depth=max_depth, top_k=top_k * 4, scoring=scoring))
    semantic_part = semantic.select(F.col("gid").alias("target"), F.col("score").alias("semantic"))
    merged = evidence.select("target", F.col("score").alias("evidence")).join(semantic_part, "target", "full")
    merged = merged.select("target", F.greatest("evidence", "semantic").alias("score"), "evidence", "semantic")
    order = [F.desc("score"), F.col("target")]
    chunks = keep(merged.withColumn("rank", F.row_number().over(Window.orderBy(*order))))  # 5 * top_k rows at most
    cited = chunks.where(F.col("rank") <= top_k)
    profile = {"entities": len(entities), "semantic_hits": semantic.count(), "evidence": evidence.count(), "fallback_flags": []}
    return GraphRAGResult(links, semantic, chunks, cited, evidence.select("seed", "target", "path_node_ids", "path_edge_ids", "path_edge_types", "score"), profile)
