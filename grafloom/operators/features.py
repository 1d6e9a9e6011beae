"""Feature lookups by node, and mini-batches for graph learning."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.errors import GraphError
from grafloom.graph import PropertyGraph
from grafloom.operators.traverse import sample_layers


class FeatureView:
    """Features by gid. `join` serves any number of ids in a cluster job; `lookup` answers a point read: from this process
    after `online`, else by a job that reads the key's rows."""

    def __init__(self, features: DataFrame, key: str = "gid") -> None:
        self.features, self.key, self.times, self.held = features, key, [], None

    def join(self, ids: DataFrame) -> DataFrame:
        """`ids` with their features, null where there are none."""
        return ids.join(self.features, self.key, "left")

    def online(self, most: int = 1_000_000) -> FeatureView:
        """Holds the features in this process as sorted columns; more than `most` rows are an error."""
        rows = self.features.orderBy(self.key).limit(most + 1).toArrow()
        if rows.num_rows > most:
            raise GraphError(6140, f"more than {most} rows of features")
        self.held = (rows[self.key].to_numpy(), rows)
        return self

    def refresh(self) -> FeatureView:
        """Reads the features again, if they are held."""
        return self if self.held is None else self.online()

    def _row(self, key: int) -> dict | None:
        keys, rows = self.held
        at = int(np.searchsorted(keys, key))
        return {n: rows[n][at].as_py() for n in rows.column_names} if at < len(keys) and keys[at] == key else None

    def lookup(self, key: int) -> dict:
        began = time.perf_counter()
        if self.held is not None:
            got = self._row(key)
        else:
            rows = self.features.where(F.col(self.key) == key).limit(1).collect()
            got = rows[0].asDict() if rows else None
        self.times.append(time.perf_counter() - began)
        return got or {}

    def lookup_many(self, keys: list[int]) -> list[dict | None]:
        if self.held is not None:
            return [self._row(k) for k in keys]
        found = {r[self.key]: r.asDict() for r in self.features.where(F.col(self.key).isin(list(keys))).collect()}
        return [found.get(k) for k in keys]

    def stats(self) -> dict:
        t = np.array(self.times or [0.0]) * 1000
        return {"lookups": len(self.times), "p50_ms": float(np.percentile(t, 50)), "p99_ms": float(np.percentile(t, 99))}


def _subgraph(edges: pd.DataFrame, first: list[int], max_nodes: int | None, max_edges: int | None) -> tuple[np.ndarray, np.ndarray]:
    edges = edges.sort_values(["layer", "src", "edge_type", "eid"], kind="stable")
    if max_nodes is not None:
        order = list(dict.fromkeys([*first, *edges[["src", "dst"]].to_numpy().ravel().tolist()]))[:max_nodes]
        edges, first = edges[edges["src"].isin(order) & edges["dst"].isin(order)], [s for s in first if s in set(order)]
    else:
        order = [*first, *edges["src"], *edges["dst"]]
    if max_edges is not None:
        edges = edges[:max_edges]
    rest = sorted(set(order) - set(first))
    n_id = np.array([*first, *rest], np.int64)
    local = {n: i for i, n in enumerate(n_id.tolist())}
    index = np.array([[local[x] for x in edges["src"]], [local[x] for x in edges["dst"]]], np.int64).reshape(2, -1)
    return index, n_id


def gnn_subgraph(g: PropertyGraph, seeds: list[int], fanouts: list[int], edge_types: list[str], direction: str = "out", strategy: str = "uniform", seed: int = 0, replace: bool = False, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`edge_index` (2 by edges, local numbers) and `n_id` (gids): the seeds, then the other nodes, in gid order.

    A mini-batch: its size is bounded by the seeds and fanouts, so it goes to the driver. With `max_nodes` or `max_edges`
    the first so many in order of layer, source, relation and edge id; edges to nodes left out are left out, too.
    """
    first = list(dict.fromkeys(seeds))
    frame = g.spark.createDataFrame([(s,) for s in first], "gid bigint")
    return _subgraph(sample_layers(g, frame, fanouts, edge_types, direction, strategy, seed, replace).toPandas(), first, max_nodes, max_edges)


def neighbor_loader(g: PropertyGraph, nodes: DataFrame, fanouts: list[int], edge_types: list[str], batch_size: int = 64, shuffle: bool = False, seed: int = 0, prefetch: int = 32, **more) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN003
    """Samples for batches of seed nodes; the seed of a batch is `seed` plus its start. `prefetch` batches are sampled in
    one pass over the edges."""
    order = F.xxhash64(F.lit(seed), "gid") if shuffle else F.col("gid")
    rows = (r["gid"] for r in nodes.select("gid").distinct().orderBy(order, "gid").toLocalIterator())
    start = 0
    while pulled := list(itertools.islice(rows, batch_size * prefetch)):
        placed = [(start + i // batch_size * batch_size, n) for i, n in enumerate(pulled)]
        edges = sample_layers(g, g.spark.createDataFrame(placed, "batch bigint, gid bigint"), fanouts, edge_types, seed=seed, **more).toPandas()
        by_batch = dict(list(edges.groupby("batch")))
        for b, group in itertools.groupby(placed, key=lambda x: x[0]):
            yield _subgraph(by_batch.get(b, edges[:0]), [n for _, n in group], None, None)
        start += len(pulled)
