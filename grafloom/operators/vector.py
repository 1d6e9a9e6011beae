"""Nearest neighbours: exact for one query, in blocks for many, and an inverted-file index with a measured recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.errors import GraphError
from grafloom.functions.builtins import cosine, dot, l2
from grafloom.plans.runtime import few, keep, scratch, ship

METRICS = {"cosine": "cosine", "l2": "l2", "dot": "dot", "ip": "dot", "dot_product": "dot"}


def distance(metric: str, a: Column, b: Column) -> Column:
    m = METRICS.get(metric)
    if m is None:
        raise GraphError(7090, f"unknown metric {metric!r}")
    return {"cosine": lambda: 1 - cosine(a, b), "l2": lambda: l2(a, b), "dot": lambda: -dot(a, b)}[m]()


def score(metric: str, a: Column, b: Column) -> Column:
    """Cosine and dot product themselves; of l2 the negative distance."""
    return {"cosine": lambda: cosine(a, b), "l2": lambda: -l2(a, b), "dot": lambda: dot(a, b)}[METRICS[metric]]()


def checked(rows: DataFrame, vector: str, dim: int, allow_null: bool = False) -> DataFrame:
    """`rows` whose vectors have `dim` numbers; others, and null unless allowed, fail the query when it runs."""
    bad = F.size(vector) != dim if allow_null else F.coalesce(F.size(vector) != dim, F.lit(True))
    return rows.withColumn(vector, F.when(bad, F.raise_error(F.lit(f"GL-7091: vectors must have {dim} numbers"))).otherwise(F.col(vector)))


def knn(rows: DataFrame, id_: str, vector: str, query: list[float], k: int, metric: str = "cosine", filters: Column | None = None) -> DataFrame:
    """The `k` rows nearest to one query: `id_`, `score`, `distance`, `rank`; ties by id. Null vectors don't count.

    Filters come before ranking, so k rows come out if so many match. One scan; each task hands on k rows.
    """
    if k < 0:
        raise GraphError(6090, "k must not be negative")
    base = rows if filters is None else rows.where(filters)
    q = F.array(*[F.lit(float(x)) for x in query])
    base = base.where(F.col(vector).isNotNull()).select(F.col(id_), score(metric, F.col(vector), q).alias("score"), distance(metric, F.col(vector), q).alias("distance"))
    best = base.orderBy(F.desc("score"), id_).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)))  # k rows at most


#: Bytes of a query matrix that is broadcast.
MATRIX_BYTES = 64 * 1024 * 1024


def _matrix(column) -> np.ndarray:  # noqa: ANN001
    """An Arrow list column without nulls, of lists of one length, as a matrix over its flat values."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float, copy=False) if len(column) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _scores(m: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of queries `b` (rows of the result) with rows `a`."""
    if m == "cosine":
        a, b = _unit(a), _unit(b)
    s = b @ a.T
    return s if m != "l2" else -np.sqrt(np.maximum(0, (b**2).sum(1)[:, None] + (a**2).sum(1)[None] - 2 * s))


def _best(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` greatest scores, of equal ones those of the least ids; -inf doesn't count."""
    if len(s) > k:
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    else:
        at = np.arange(len(s))
    at = at[np.lexsort((ids[at], -s[at]))][:k]
    return at[s[at] > -np.inf]


class _Best:
    """The best `k` rows of every query so far."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.ids, self.scores = [np.empty(0, np.int64)] * len(queries), [np.empty(0)] * len(queries)

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        s = np.where(ids[None] == self.queries[:, None], -np.inf, s)
        for i in range(len(self.queries)):
            at = _best(ids, s[i], self.k)
            both, score = np.concatenate([self.ids[i], ids[at]]), np.concatenate([self.scores[i], s[i][at]])
            at = _best(both, score, self.k)
            self.ids[i], self.scores[i] = both[at], score[at]

    def batch(self):  # noqa: ANN201
        import pyarrow as pa

        n = [len(x) for x in self.ids]
        parts = [np.repeat(self.queries, n), np.concatenate([*self.ids, np.empty(0, np.int64)]), np.concatenate([*self.scores, np.empty(0)])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "id", "score"])


_HITS = "query bigint, id bigint, score double"


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, id_: str, vector: str, block: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries as matrices of at most `MATRIX_BYTES` and about `block` rows, one after the other, by hash."""
    q = keep(queries.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("q"), F.col(vector).alias("v")))
    n, width = q.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-n * width * 8 // MATRIX_BYTES), -(-n // (block or max(n, 1))))
    for b in range(blocks if n else 0):
        t = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        if t.num_rows:
            yield t["q"].to_numpy(), _matrix(t["v"].combine_chunks())


def knn_join(rows: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, metric: str = "cosine", block: int | None = None) -> DataFrame:
    """The `k` rows nearest to each of `queries` (same columns; the query itself left out): `query`, `id`, `score`, `rank`.

    A stated query set against all rows, in blocks: the queries are broadcast as matrices of at most `MATRIX_BYTES`; for
    each a task goes over its rows batch by batch, multiplies the two matrices and keeps its k best per query. Only these
    are shuffled. Ties by id. Null vectors don't count, all others must be of one length. Scores are double.
    """
    spark, m = rows.sparkSession, METRICS[metric]
    ship(spark)
    data = rows.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"))
    parts = []
    for qs, matrix in _query_blocks(queries, id_, vector, block):
        shared = spark.sparkContext.broadcast((qs, matrix))

        def best(batches: Iterator, shared=shared) -> Iterator:  # noqa: ANN001
            qs, matrix = shared.value
            found = _Best(qs, k)
            for b in batches:
                if b.num_rows:
                    found.add(b.column(0).to_numpy(), _scores(m, _matrix(b.column(1)), matrix))
            yield found.batch()

        parts.append(data.mapInArrow(best, _HITS))
    return _ranked(reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], _HITS), k)


def _lists_for(n: int) -> int:
    """About the root of the number of rows."""
    return int(min(4096, max(1, round(n**0.5))))


class InvertedFile:
    """Centres fitted on a bounded sample, every row stored with its nearest one; a search reads `probes` lists.

    With a `folder` the rows are written there by list, so that a search reads the folders of its lists only; without
    one they go to the shared folder.
    """

    def __init__(self, rows: DataFrame, id_: str, vector: str, lists: int | None = None, sample: int = 20_000, seed: int = 0, rounds: int = 8, folder: str | None = None) -> None:
        """`lists`: by default about the root of the number of rows. At most `sample` rows (those with the least hash of
        the id) are used to fit; all rows with a vector are stored."""
        spark = rows.sparkSession
        ship(spark)
        self.id, self.vector, self.spark = id_, vector, spark
        some = rows.where(F.col(vector).isNotNull())
        got = some.orderBy(F.xxhash64(F.lit(seed), id_)).limit(sample).select(id_, vector).toArrow()
        x = _unit(_matrix(got[vector].combine_chunks())) if got.num_rows else np.empty((0, 0))
        lists = _lists_for(some.count() if lists is None and got.num_rows == sample else len(x)) if lists is None else lists
        centres = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            near = (x @ centres.T).argmax(1) if len(x) else np.empty(0, int)
            centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))]).reshape(centres.shape)
            centres = _unit(centres) if len(centres) else centres
        self.centres, self.fitted, self.ids = centres, x, got[id_].to_numpy()
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                v = _matrix(b.column(b.schema.names.index(vector)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((v @ shared.value.T).argmax(1) if len(v) else [], pa.int32())], names=[*b.schema.names, "list_"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", list_ int"
        placed = some.mapInArrow(assign, schema)
        self.folder = folder or scratch(spark, "lists")
        # A list with many rows is written by several tasks.
        placed.repartition("list_", F.shiftright(F.xxhash64(id_), 62)).write.partitionBy("list_").parquet(self.folder)
        self.rows = spark.read.schema(placed.schema).parquet(self.folder)

    def near(self, query: list[float], probes: int) -> DataFrame:
        """The rows of the `probes` lists nearest to a query; only their folders are read."""
        lists = [int(i) for i in np.argsort(-(self.centres @ np.array(query, float)), kind="stable")[:probes]]
        return self.rows.where(F.col("list_").isin(lists)).drop("list_")

    def search(self, query: list[float], k: int, probes: int = 8) -> DataFrame:
        return knn(self.near(query, probes), self.id, self.vector, query, k)

    def probes_for(self, recall: float, k: int, queries: DataFrame | None = None, most: int = 500) -> int:
        """The fewest lists to look at for a mean recall of `recall`, as measured among the rows the index was fitted on.

        Up to `most` of these rows are searched for, with two standard errors of the mean to spare; of `queries` (same
        columns, if given) also up to `most`, those with the least hash of the id. A query itself is never its own
        neighbour. Where no smaller number is enough it is all lists, which is exact.
        """
        x, n = self.fitted, len(self.centres)
        if len(x) <= k:
            return n
        lists = (x @ self.centres.T).argmax(1)

        def shares(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
            """Per query and number of lists, the share of its `k` nearest rows that are found."""
            out = []
            for i, v in zip(ids, vectors, strict=True):
                s = np.where(self.ids == i, -np.inf, x @ v)
                place = np.empty(n, int)
                place[np.argsort(-(self.centres @ v), kind="stable")] = np.arange(n)
                out.append((place[lists[np.argpartition(-s, k - 1)[:k]]][None] < np.arange(n + 1)[:, None]).mean(1))
            return np.array(out)

        own = shares(self.ids[:most], x[:most])
        enough = own.mean(0) - 2 * own.std(0) / len(own) ** 0.5 >= recall
        if queries is not None:
            got = queries.where(F.col(self.vector).isNotNull()).orderBy(F.xxhash64(self.id), self.id).limit(most).select(self.id, self.vector).toArrow()
            if got.num_rows:
                enough &= shares(got[self.id].to_numpy(), _matrix(got[self.vector].combine_chunks())).mean(0) >= recall
        return next((p for p in range(1, n) if enough[p]), n)

    def search_join(self, queries: DataFrame, k: int, probes: int, block: int | None = None) -> DataFrame:
        """As `knn_join` by cosine, but each of `queries` (same columns) sees the rows of its nearest `probes` lists only.

        Queries are broadcast in blocks with the lists they look at. A task takes the rows of a batch list by list, each
        with the queries that look there."""
        parts, c = [], self.centres
        data = self.rows.select("list_", F.col(self.id).cast("long").alias("id"), F.col(self.vector).alias("v"))
        for qs, matrix in _query_blocks(queries, self.id, self.vector, block):
            near = np.argsort(-(matrix @ c.T), axis=1, kind="stable")[:, :probes]
            asked = {int(x): np.flatnonzero((near == x).any(1)) for x in np.unique(near)}
            shared = self.spark.sparkContext.broadcast((qs, matrix, asked))

            def best(batches: Iterator, shared=shared) -> Iterator:  # noqa: ANN001
                qs, matrix, asked = shared.value
                found = _Best(qs, k)
                for b in batches:
                    if not b.num_rows:
                        continue
                    lists, ids, v = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
                    s = np.full((len(qs), len(ids)), -np.inf)
                    for x in np.unique(lists):
                        if int(x) in asked:
                            at, who = np.flatnonzero(lists == x), asked[int(x)]
                            s[np.ix_(who, at)] = _scores("cosine", v[at], matrix[who])
                    found.add(ids, s)
                yield found.batch()

            parts.append(data.where(F.col("list_").isin(list(asked))).mapInArrow(best, _HITS))
        return _ranked(reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], _HITS), k)


def graph_boosts(adjacency: DataFrame | Callable, candidates: DataFrame, boosts: list[dict], vector_score: str = "score") -> DataFrame:
    """`candidates` (`gid`, score) with `boost`: the sum over `boosts` of weight times a signal.

    Signals: `degree` (steps in and out), `edge_weight_sum` (their weights), `mentions_entity` (next to any gid of
    `entities`). Half a point more for each further source that supports a candidate: a touched entity set, or a score
    above 0.5. `adjacency` must have both directions, or gives the steps from a list of nodes.
    """
    if not isinstance(adjacency, DataFrame):
        candidates = keep(candidates)
        adjacency = adjacency(few(candidates, "gid"))
    c = candidates.select("gid", F.col(vector_score).alias("s_"))
    flags = [F.max(F.col("next").isin(list(b["entities"]))).alias(f"e{i}") if b["signal"] == "mentions_entity" else F.lit(False).alias(f"e{i}") for i, b in enumerate(boosts)]
    per = adjacency.join(F.broadcast(candidates.select("gid")), F.col("node") == F.col("gid")).groupBy("gid").agg(F.count("*").alias("degree_"), F.sum("w").alias("weight_"), *flags)
    j = c.join(per, "gid", "left")
    value, sources = F.lit(0.0), (F.col("s_") > 0.5).cast("int")
    for i, b in enumerate(boosts):
        hit = F.coalesce(F.col(f"e{i}"), F.lit(False))
        signal = {"degree": F.coalesce("degree_", F.lit(0)), "edge_weight_sum": F.coalesce("weight_", F.lit(0.0)), "mentions_entity": hit.cast("double")}.get(b["signal"])
        if signal is None:
            raise GraphError(6020, f"unknown boost {b['signal']!r}")
        value += float(b.get("weight", 1.0)) * signal
        if b["signal"] == "mentions_entity":
            sources += hit.cast("int")
    return candidates.join(j.select("gid", (value + 0.5 * F.greatest(F.lit(0), sources - 1)).alias("boost")), "gid")


def vector_search(rows: DataFrame, vector: str, query: list[float], top_k: int, metric: str = "cosine", filters: dict | None = None, boosts: list[dict] | None = None, adjacency: DataFrame | Callable | None = None, oversample: int = 4) -> DataFrame:
    """Nodes (`gid`, `node_id`, ...) by score and gid: `gid`, `node_id`, `score`, `distance`, `vector_score`,
    `graph_boost_score`, `rank`. With boosts, `oversample` times as many nearest nodes are ranked again."""
    if top_k < 0:
        raise GraphError(6090, "top_k must not be negative")
    base = rows
    for c, value in (filters or {}).items():
        base = base.where(F.col(c).eqNullSafe(F.lit(value)))
    hits = knn(base, "gid", vector, query, top_k * (oversample if boosts else 1), metric).drop("rank").withColumnRenamed("score", "vector_score")
    if boosts:
        hits = graph_boosts(adjacency, hits, boosts, "vector_score").withColumnRenamed("boost", "graph_boost_score")
    else:
        hits = hits.withColumn("graph_boost_score", F.lit(0.0))
    hits = hits.withColumn("score", F.col("vector_score") + F.col("graph_boost_score")).orderBy(F.desc("score"), "gid").limit(top_k)
    named = rows.select("gid", "node_id").join(F.broadcast(hits), "gid")  # top_k rows
    return named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "gid")))
