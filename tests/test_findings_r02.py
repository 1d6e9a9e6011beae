"""Findings of the second round: aggregates over patterns that share nodes, and paths along many parallel edges."""

import math
import random
from threading import Timer

import pytest
from pyspark.sql import functions as F

from grafloom.graph import PropertyGraph
from grafloom.lang.compiler import Compiler, compile_query
from grafloom.operators import traverse


@pytest.fixture
def limited(spark):
    """Ends the jobs of a test that takes more than a minute and a half."""
    timer = Timer(90, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def test_patterns_that_share_a_node_without_all_pairs(spark, limited):
    n = 100_000
    nodes = spark.range(2 * n).select(F.col("id").alias("gid"), F.col("id").cast("string").alias("node_id"), F.col("id").alias("x"))
    places = spark.createDataFrame([(-1, "p", "one"), (-2, "q", "two")], "gid long, node_id string, name string")
    edges = nodes.select("gid", F.col("gid").alias("src"), F.lit(-1).cast("long").alias("dst")).withColumnRenamed("gid", "eid")
    g = PropertyGraph(spark, {"A": nodes.where(F.col("gid") < n), "B": nodes.where(F.col("gid") >= n), "P": places}, {"in": edges})
    r = compile_query(g, "MATCH (a:A)-[:in]->(p:P), (b:B)-[:in]->(p) WHERE b.x > 9 RETURN p.name, count(DISTINCT a.gid) AS a, count(DISTINCT b.gid) AS b")
    assert [tuple(x) for x in r.collect()] == [("one", n, n)]  # 10^10 pairs


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(5)
    # Two rows of some gids, names that are null or shared, and edges without an end.
    rows = [(i, str(i), r.choice([None, "u", "v"]), r.randrange(5)) for i in [*range(18), 2, 5, 7]]
    nodes = spark.createDataFrame(rows, "gid long, node_id string, name string, x int")
    edges = spark.createDataFrame([(k, r.choice([None, *range(18)]), r.randrange(18), r.random()) for k in range(60)], "eid long, src long, dst long, weight double")
    return PropertyGraph(spark, {"A": nodes.where("gid % 3 = 0"), "B": nodes.where("gid % 3 = 1"), "C": nodes.where("gid % 3 = 2")}, {"r": edges.where("eid % 2 = 0"), "s": edges.where("eid % 2 = 1")})


@pytest.mark.parametrize(
    ("text", "apart"),
    [
        ("MATCH (a:A)-[:r]-(c:C), (b:B)-[:s]-(c) RETURN c.name, count(DISTINCT a.gid) AS a, min(b.x) AS b, sum(DISTINCT b.x) AS s", True),
        ("MATCH (a:A)-[:r]-(c:C), (b:B)-[:s]-(c) WHERE a.x > c.x AND b.x < 4 RETURN c.name, count(DISTINCT a.x) AS a, max(b.gid) AS b", True),
        ("MATCH (a:A)-[:r]-(c:C), (b:B)-[:s]-(c) WHERE a.x > 7 RETURN count(DISTINCT a.x) AS a, max(b.gid) AS b", True),
        ("MATCH (a:A)-[:r]-(c:C), (c)-[:s]-(b:B), (b)-[e:r]-(d) RETURN b.name, count(DISTINCT a.gid) AS a, count(DISTINCT e.eid) AS e", True),
        ("MATCH (a:A)-[:r]-(c), (b:B)-[:s]-(c), (c)-[:r]-(d:B) RETURN c.x + 1 AS x, count(DISTINCT a.gid) + count(DISTINCT d.x) AS n, count(DISTINCT b.x) AS b", True),
        ("MATCH (a:A)-[:r]-(c:C), (b:B)-[:s]-(c) WITH c, count(DISTINCT a.gid) AS a, count(DISTINCT b.gid) AS b WHERE a > 1 RETURN c.gid, c.name, a, b", True),
        ("MATCH (a:A)-[:r]-(c:C), (b:B)-[:s]-(c) RETURN c.name, count(*) AS n, count(DISTINCT a.gid) AS a", False),
        ("MATCH (a:A)-[:r]-(c:C), (b:B)-[:s]-(c) WHERE a.x < b.x RETURN c.name, count(DISTINCT a.gid) AS a", False),
        ("MATCH (a:A)-[:r]-(c:C), (b:B)-[:s]-(c) RETURN a.name, count(DISTINCT b.gid) AS b", False),
        ("MATCH (a:A), (b:B)-[:s]-(c) RETURN count(DISTINCT a.gid) AS a, count(DISTINCT b.gid) AS b", False),
        ("MATCH (a:A)-[:r]-(c:C), (b:B)-[:s]-(c:C) RETURN c.name, count(DISTINCT a.gid) AS a, count(DISTINCT b.gid) AS b", False),
    ],
)
@pytest.mark.filterwarnings("ignore:a pattern shares no name")
def test_patterns_apart_give_the_same_groups(small, text, apart, monkeypatch):
    used, method = [], Compiler._apart

    def watched(self, *args):  # noqa: ANN001, ANN002, ANN202
        used.append(method(self, *args))
        return used[-1]

    monkeypatch.setattr(Compiler, "_apart", watched)
    rows = sorted(map(repr, compile_query(small, text).collect()))
    assert [x is not None for x in used] == [apart]
    monkeypatch.setattr(Compiler, "_apart", lambda self, *args: None)
    assert rows == sorted(map(repr, compile_query(small, text).collect()))


def test_best_paths_along_many_parallel_edges(spark, limited):
    n = 60_000
    edges = spark.range(2 * n).select(F.col("id").alias("eid"), (F.col("id") % 2).alias("src"), (F.col("id") % 2 + 1).alias("dst"), (F.col("id").cast("double") / n).alias("weight"))
    g = PropertyGraph(spark, {}, {"r": edges})
    found = traverse.paths(g, 0, 2, ["r"], max_depth=2, limit=3, score="sum").select("edge_ids").collect()  # of 3.6 * 10^9
    assert [x.edge_ids for x in found] == [[2 * n - 2, 2 * n - 1], [2 * n - 4, 2 * n - 1], [2 * n - 2, 2 * n - 3]]


# 1 + 2^-53 is 1, so that a greater weight may make no greater sum, and the lesser id comes first.
WEIGHTS = {
    "few": [0.5, 1.0, 2.0], "negative": [-1.0, -0.5, 0.0, 0.75], "near": [1.0, 2.0**-53, 2.0**-54, 0.0, 1.0 + 2.0**-52], "spread": [k / 7 for k in range(40)],
    "not finite": [float("nan"), float("inf"), -float("inf"), 1.0, 2.0], "great": [1e308, 1.5e308, 1.0],
}


@pytest.mark.parametrize("kind", WEIGHTS)
def test_the_steps_that_stay_give_the_first_of_all_paths(spark, kind):
    r = random.Random(9)
    ends = [(0, 1), (1, 2), (0, 2), (2, 1), (2, 3), (1, 3), (0, 3)]
    rows = [(*r.choice(ends), r.choice("rs"), k, r.choice(WEIGHTS[kind]), "out") for k in r.sample(range(1000), 120)]
    steps = spark.createDataFrame(rows, "node long, next long, edge_type string, eid long, w double, direction string").coalesce(1)
    for score, order, limit in [("sum", "desc", 3), ("average", "asc", 2), (None, "desc", 3), ("min", "desc", 3)]:
        most = max((abs(x[4]) for x in rows), key=lambda x: (math.isnan(x), x))
        stay = [tuple(x) for x in traverse.Best(limit, score, order, most).steps(steps, 3).collect()]
        assert len(stay) < len(rows) or score == "min" or kind == "spread"
        assert first_paths(stay, score, order, limit) == first_paths(rows, score, order, limit), (score, order)


def first_paths(rows, score, order, limit):
    """In order of score, depth, nodes and edges; NaN is the greatest score."""
    found = []

    def walk(nodes, eids, weights):
        if nodes[-1] == 3:
            total = 0.0
            for w in weights:
                total += w
            key = lambda x: (math.isnan(x), 0.0 if math.isnan(x) else x)
            value = {None: (False, 0.0), "sum": key(total), "average": key(total / len(weights)), "min": min(map(key, weights))}[score]
            found.append(((*(-x for x in value),) if order == "desc" else value, len(eids), nodes, eids))
        elif len(eids) < 3:
            for node, nxt, _, eid, w, _ in rows:
                if node == nodes[-1] and nxt not in nodes:
                    walk([*nodes, nxt], [*eids, eid], [*weights, w])

    walk([0], [], [])
    return sorted(found)[:limit]
