"""Graph questions to a database by external id; thin layers over the operators, which work with internal ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafloom.errors import GraphError
from grafloom.graph import PropertyGraph, union_all
from grafloom.operators import features, indexes, retrieve, traverse
from grafloom.plans.runtime import among, few, keep


class Result:
    """A lazy result: `df`, or its rows as Arrow or dicts."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def arrow(self):  # noqa: ANN201
        return self.df.toArrow()

    def rows(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def record_batches(self):  # noqa: ANN201
        return iter(self.arrow().to_batches())


def _list(x: Any) -> list:  # noqa: ANN401
    return list(x) if isinstance(x, (list, tuple, set, np.ndarray)) else [x]


class GraphApi:
    """What `Database` can be asked about its graph. Nodes are named by external id, or by gid where no id equals it."""

    graph: PropertyGraph

    # --- names

    def _refs(self, refs: Any) -> DataFrame:  # noqa: ANN401
        return self.graph.resolve(_list(refs))

    def _gid(self, ref: Any) -> int:  # noqa: ANN401
        return self._refs([ref]).first()["gid"]

    def _names_of(self, rows: DataFrame, arrays: list[str], by: list[str]) -> DataFrame:
        """`rows` with the gids in `arrays` replaced by external ids; `by` names a row."""
        rows = keep(rows)
        for a in arrays:
            each = rows.select(*by, F.posexplode(a).alias("i_", "g_"))
            named = self.graph.named(each, "g_", few(each, "g_"))
            ids = named.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", F.coalesce("node_id", F.col("g_").cast("string")).alias("n")))), lambda x: x["n"]).alias("a_"))
            rows = rows.join(ids, by, "left").withColumn(a, F.coalesce("a_", F.array().cast("array<string>"))).drop("a_")
        return rows

    def _with_properties(self, rows: DataFrame, gid: str, names: Iterable[str] | None) -> DataFrame:
        """`rows` with properties of the node in `gid`, null where a class has none of that name."""
        names = list(names or [])
        if not names:
            return rows
        ids = few(rows, gid)
        parts = []
        for n, df in self.graph.stored_nodes.items():
            have = [c for c in names if c in df.columns]
            if have:
                part = self.graph.nodes(n).select(F.col("gid").alias("p_"), *have)
                parts.append(part if ids is None else part.where(among("p_", ids)))
        if not parts:
            raise GraphError(6020, f"no class has {', '.join(names)}")
        got = union_all(parts)
        return rows.join(got, F.col(gid) == F.col("p_"), "left").drop("p_").withColumns({c: F.lit(None) for c in names if c not in got.columns})

    # --- neighbourhoods

    def out(self, nodes: Any, edge_type: str, return_eids: bool = False) -> DataFrame:  # noqa: ANN401
        """`src`, `dst` (gids) of the edges that leave `nodes`; with `return_eids` also `eid`. None for an unknown relation."""
        return self._adjacent(nodes, edge_type, False, return_eids)

    def in_(self, nodes: Any, edge_type: str, return_eids: bool = False) -> DataFrame:  # noqa: ANN401
        return self._adjacent(nodes, edge_type, True, return_eids)

    def _adjacent(self, nodes: Any, edge_type: str, incoming: bool, eids: bool) -> DataFrame:  # noqa: ANN401
        wanted = self._refs(nodes)
        if edge_type not in self.graph.stored_edges:
            return self.spark.createDataFrame([], "src bigint, dst bigint, eid bigint").select("src", "dst", *["eid"] * eids)
        return traverse.out_edges(self.graph, wanted, edge_type, incoming).select("src", "dst", *["eid"] * eids)

    def degree(self, nodes: Any, edge_type: str, direction: str = "out") -> int | DataFrame:  # noqa: ANN401
        """The degree of one node, or `node_id` (gid), `degree` of several."""
        if direction not in ("out", "in", "both"):
            raise GraphError(6020, f"invalid direction {direction!r}")
        df = traverse.degree(self.graph, edge_type, direction, self._refs(nodes)).withColumnRenamed("gid", "node_id")
        return df if isinstance(nodes, (list, tuple, set, np.ndarray)) else df.first()["degree"]

    def common_neighbors(self, left: Any, right: Any, edge_type: str, direction: str = "out") -> DataFrame:  # noqa: ANN401
        return traverse.common_neighbors(self.graph, self._gid(left), self._gid(right), edge_type, direction).withColumnRenamed("gid", "node_id")

    def overlap(self, node: Any, candidates: Iterable, edge_type: str, direction: str = "out", top_k: int | None = None) -> DataFrame:  # noqa: ANN401
        if top_k is not None and top_k < 0:
            raise GraphError(6020, "top_k must not be negative")
        return traverse.overlap(self.graph, self._gid(node), self._refs(candidates), edge_type, direction, top_k).withColumnRenamed("gid", "node_id")

    def neighbors(
        self, seed_node_ids: Any, edge_types: Iterable[str] | None = None, direction: str = "out", depth: int = 1, limit: int | None = None, node_types: list[str] | None = None, edge_filters: dict | None = None,  # noqa: ANN401
        return_paths: bool = False, weight_property: str = "weight", top_edges_per_node: int | None = None, path_score: str | None = None, order_by_score: str | None = None, return_properties: Iterable[str] | None = None,
    ) -> Result:
        """See `traverse.neighbors`, in order; with `return_paths` also the paths, their nodes by external id."""
        types = list(edge_types) if edge_types is not None else None
        df = traverse.neighbors(self.graph, self._refs(seed_node_ids), types, direction, depth, limit, node_types, edge_filters, weight_property, top_edges_per_node, path_score, order_by_score)
        # The order is a column, as joins below don't keep it: those of discovery compare by the edges that led there.
        order = ([F.desc_nulls_last("path_score") if order_by_score == "desc" else F.asc_nulls_last("path_score")] if order_by_score else []) + [F.col("depth"), F.col("internal_id") if order_by_score else F.arrays_zip("path_edge_types", "path_edge_ids")]
        if return_paths:
            df = self._names_of(df, ["path_node_ids"], ["internal_id"])
        df = self._with_properties(df, "internal_id", return_properties).orderBy(*order)
        return Result(df if return_paths else df.drop("path_node_ids", "path_edge_ids", "path_edge_types"))

    def k_hop(self, seeds: Any, depth: int, edge_types: Iterable[str] | None = None, direction: str = "both", max_nodes: int | None = 500, max_edges: int | None = 2000) -> dict[str, DataFrame]:  # noqa: ANN401
        types = list(edge_types) if edge_types is not None else None
        nodes, edges = traverse.k_hop(self.graph, self._refs(seeds), depth, types, direction, max_nodes, max_edges)
        return {"nodes": nodes.orderBy("depth", "internal_id"), "edges": edges.orderBy("depth", "edge_type", "eid")}

    def paths(
        self, source: Any = None, target: Any = None, edge_types: Iterable[str] | None = None, max_depth: int = 3, limit: int | None = 20, direction: str = "out", edge_filters: dict | None = None, score: str | None = None,  # noqa: ANN401
        score_property: str = "weight", order: str = "desc", sources: Any = None, target_node_types: Any = None, max_paths_per_seed: int | None = 20, return_properties: Iterable[str] | None = None,  # noqa: ANN401
    ) -> Result:
        """Simple paths between two nodes, or from `sources` to nodes of `target_node_types`, best first."""
        types = list(edge_types) if edge_types is not None else None
        if sources is not None or target_node_types is not None:
            if target_node_types is None or (sources is None and source is None):
                raise GraphError(6020, "paths from several nodes take sources and target_node_types")
            df = traverse.multi_seed_paths(self.graph, self._refs(sources if sources is not None else source), _list(target_node_types), types, max_depth, direction, max_paths_per_seed, score or "product", score_property, limit)
            df = self._with_properties(self._names_of(df, ["path_node_ids"], ["seed", "path_edge_ids", "path_edge_types"]), "target", return_properties)
            return Result(df.orderBy(F.desc_nulls_last("score"), "depth", "seed", "target", "path_edge_ids"))
        if source is None or target is None:
            raise GraphError(6020, "paths take source and target, or sources and target_node_types")
        df = traverse.paths(self.graph, self._gid(source), self._gid(target), types, max_depth, limit, direction, edge_filters, score, score_property, order)
        df = self._names_of(df.withColumn("node_ids", F.col("internal_node_ids")), ["node_ids"], ["internal_node_ids", "edge_ids"])
        by = ([F.desc_nulls_last("path_score") if order == "desc" else F.asc_nulls_last("path_score")] if score else []) + [F.col("depth"), F.col("internal_node_ids"), F.col("edge_ids")]
        return Result(df.orderBy(*by).select("depth", "node_ids", "internal_node_ids", "edge_ids", "relation_types", "directions", "edge_properties", "path_score"))

    def shortest_path(self, source: Any, target: Any, edge_types: Iterable[str] | None = None, max_depth: int | None = None, direction: str = "out", edge_filters: dict | None = None) -> dict | None:  # noqa: ANN401
        """The least path by depth, nodes and edges as a dict; of a node to itself one of no steps; None if there is none."""
        a, b = self._gid(source), self._gid(target)
        if a == b:
            row = {"depth": 0, "internal_node_ids": [a], "edge_ids": []}
        else:
            got = traverse.shortest_path(self.graph, a, b, list(edge_types) if edge_types is not None else None, max_depth, direction, edge_filters).collect()
            if not got:
                return None
            row = {"depth": got[0]["depth"], "internal_node_ids": got[0]["nodes"], "edge_ids": got[0]["eids"]}
        names = {r["gid"]: r["node_id"] for r in self.graph.node_index().where(among("gid", row["internal_node_ids"])).collect()}
        return row | {"node_ids": [names.get(n, str(n)) for n in row["internal_node_ids"]]}

    # --- retrieval

    def link_entities(
        self, query_text: str, text_index: str | None = None, vector_index: str | None = None, query_vector: list[float] | None = None, top_k: int = 5, policies: dict | None = None, return_properties: Iterable[str] | None = None
    ) -> Result:
        """Entities that a text names, by a text index, a vector index or both."""
        if text_index is None and vector_index is None:
            raise GraphError(6120, "link_entities takes a text index or a vector index")
        hits = self.text_hits(text_index, query_text) if text_index else None
        vectors = self._vectors(vector_index, query_vector) if vector_index else None
        df = retrieve.link_entities(self.graph, query_text, hits, top_k, policies, vectors)
        df = self._with_properties(self.graph.named(df, "gid", few(df, "gid")), "gid", return_properties)
        return Result(df.withColumnRenamed("gid", "internal_id").orderBy("rank"))

    def evidence_search(
        self, seed_node_ids: Any, target_node_type: str = "Chunk", edge_types: Iterable[str] | None = None, direction: str = "both", max_depth: int = 2, top_k: int = 36, max_paths_per_seed: int = 8,  # noqa: ANN401
        top_edges_per_node: int | None = 24, seed_scores: dict | None = None, scoring: dict | None = None, return_properties: Iterable[str] | None = None,
    ) -> Result:
        refs = _list(seed_node_ids)
        scores = self.spark.createDataFrame([(i, float((seed_scores or {}).get(getattr(r, "external_id", r), 1.0))) for i, r in enumerate(refs)], "pos bigint, seed_score double")
        seeds = self._refs(refs).join(scores, "pos")
        df = retrieve.evidence_search(self.graph, seeds, target_node_type, list(edge_types) if edge_types is not None else None, direction, max_depth, top_k, max_paths_per_seed, top_edges_per_node, scoring)
        return Result(self._evidence(df, return_properties).orderBy("rank"))

    def _evidence(self, df: DataFrame, properties: Iterable[str] | None) -> DataFrame:
        df = self._names_of(df, ["path_node_ids"], ["seed", "path_edge_ids", "path_edge_types"])
        for gid, a, b in (("target", "target_node_id", "target_node_type"), ("seed", "source_seed_id", "source_seed_type")):
            df = self.graph.named(df, gid, few(df, gid)).withColumnsRenamed({"node_id": a, "node_type": b})
        df = self._with_properties(df, "target", properties)
        first = ["target_node_id", "target_node_type", "score", "rank", "depth", "source_seed_id", "source_seed_type"]
        return df.select(*first, *[c for c in df.columns if c not in first])

    def graphrag_search(
        self, query_text: str, query_vector: list[float], chunk_vector_index: str, entity_text_index: str, edge_types: Iterable[str] | None = None, direction: str = "out", max_depth: int = 2, top_k: int = 8, citation_top_k: int = 3,
        scoring: dict | None = None, return_properties: Iterable[str] | None = None,
    ) -> retrieve.GraphRAGResult:
        """Entity links, chunks by vector, evidence from both, citations and paths, each a `Result`, and a profile."""
        r = retrieve.graphrag_search(self.graph, query_text, self.text_hits(entity_text_index, query_text), self._vectors(chunk_vector_index, query_vector), top_k, list(edge_types) if edge_types is not None else None, direction, max_depth, scoring)
        name = lambda df, gid: self.graph.named(df, gid, few(df, gid))
        chunks = self._with_properties(name(r.evidence_chunks, "target"), "target", return_properties).withColumnsRenamed({"node_id": "chunk_id", "target": "internal_id"}).orderBy("rank")
        semantic = self._with_properties(r.semantic_hits.join(self.graph.node_index().select("gid", "node_type"), "gid"), "gid", return_properties).withColumnRenamed("gid", "internal_id")
        paths = self._evidence(r.paths.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "target"))).withColumn("depth", F.size("path_edge_ids")), None)  # evidence rows, few
        return retrieve.GraphRAGResult(Result(name(r.entity_links, "gid").orderBy("rank")), Result(semantic.orderBy("rank")), Result(chunks), Result(chunks.where(F.col("rank") <= citation_top_k)), Result(paths), r.profile)

    # --- learning

    def sample_gnn_subgraph(
        self, seeds: Any, fanouts: list[int], edge_types: list[str], direction: str = "out", id_space: str = "external", replace: bool = False, seed: int = 0, strategy: str = "uniform", max_nodes: int | None = None,  # noqa: ANN401
        max_edges: int | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """`edge_index` and `n_id` of a sampled neighbourhood; `seeds` are external ids, or gids in the id space `internal`."""
        return features.gnn_subgraph(self.graph, self._seed_gids(seeds, id_space), fanouts, edge_types, direction, strategy, seed, replace, max_nodes, max_edges)

    def _seed_gids(self, seeds: Any, id_space: str) -> list[int]:  # noqa: ANN401
        if id_space not in ("external", "internal"):
            raise GraphError(6020, f"unknown id space {id_space!r}")
        return [int(s) for s in _list(seeds)] if id_space == "internal" else [r["gid"] for r in self._refs(seeds).orderBy("pos").collect()]

    def neighbor_loader(
        self, input_nodes: Any, fanouts: list[int], edge_types: list[str], batch_size: int = 64, shuffle: bool = False, filter: str | None = None, id_space: str = "external", seed: int = 0, direction: str = "out",  # noqa: A002, ANN401
        strategy: str = "uniform", replace: bool = False,
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Mini-batches over the nodes of a class (its name, with a predicate in `filter`), over given ones, or all (None)."""
        if input_nodes is None:
            nodes = self.graph.node_index()
        elif isinstance(input_nodes, str) and input_nodes in self.catalog.classes:
            nodes = self.query_nodes(input_nodes, filter or "")
        else:
            nodes = self.spark.createDataFrame([(g,) for g in self._seed_gids(input_nodes, id_space)], "gid bigint")
        return features.neighbor_loader(self.graph, nodes, fanouts, edge_types, batch_size, shuffle, seed, direction=direction, strategy=strategy, replace=replace)

    # --- indexes

    def text_hits(self, index: str, query: str) -> DataFrame:
        """The entries of a text index that share a token with the query."""
        self._index_def(index, "text")
        return indexes.text_candidates(self.spark, self.built(index), query)

    def _vectors(self, index: str, query: list[float] | None) -> tuple[DataFrame, str, list[float]]:
        i = self._index_def(index, "vector")
        if query is None or len(query) != i.options["dim"]:
            raise GraphError(6061, f"the query has {len(query or [])} numbers, the index {i.options['dim']}")
        return self.graph.nodes(i.node_type), i.columns[0], list(query)
