"""The traversals on a small random graph, against plain Python, and the expected values of known small graphs."""

import random

import pytest

from grafloom.errors import GraphError
from grafloom.graph import PropertyGraph
from grafloom.operators import algebra, ontology, retrieve, text, traverse, vector


@pytest.fixture(scope="module")
def g(spark):
    r = random.Random(8)
    n = 12
    nodes = [(i, f"n{i}", 1.0 * i) for i in range(n)]
    edges = [(k, r.randrange(n), r.randrange(n), round(r.random(), 2)) for k in range(30)] + [(30, 0, None, 0.5), (31, None, 1, 0.5)]
    a = spark.createDataFrame(nodes, "gid long, node_id string, x double")
    e = spark.createDataFrame(edges, "eid long, src long, dst long, weight double")
    return PropertyGraph(spark, {"A": a.where("gid % 3 > 0"), "T": a.where("gid % 3 = 0")}, {"r": e.where("eid % 2 = 0"), "s": e.where("eid % 2 = 1")})


def steps(g, direction="out"):
    out = []
    for name in ("r", "s"):
        for e in g.edges(name).collect():
            if e.src is None or e.dst is None:
                continue
            if direction in ("out", "both"):
                out.append((e.src, e.dst, name, e.eid, e.weight))
            if direction in ("in", "both"):
                out.append((e.dst, e.src, name, e.eid, e.weight))
    return out


def seeds(spark, *gids):
    return spark.createDataFrame(list(enumerate(gids)), "pos long, gid long")


def bfs(edges, first, depth):
    """Node to (depth, edge by which it is first seen), in order of discovery."""
    seen, frontier = dict.fromkeys(first, (0, None)), list(first)
    for d in range(1, depth + 1):
        level = []
        for node in frontier:
            for _, nxt, _, eid, _ in sorted((e for e in edges if e[0] == node), key=lambda e: (e[2], e[3], e[1])):
                if nxt not in seen:
                    seen[nxt] = (d, eid)
                    level.append(nxt)
        frontier = level
    return seen


def all_paths(edges, source, depth):
    todo, out = [((source,), ())], []
    while todo:
        nodes, eids = todo.pop()
        if eids:
            out.append((nodes, eids))
        if len(eids) < depth:
            todo += [((*nodes, e[1]), (*eids, e[3])) for e in edges if e[0] == nodes[-1] and e[1] not in nodes]
    return out


def test_neighbors_and_k_hop(spark, g):
    got = {r.internal_id: (r.depth, r.via_edge_id) for r in traverse.neighbors(g, seeds(spark, 3, 7), depth=3).collect()}
    assert got == {k: v for k, v in bfs(steps(g), [3, 7], 3).items() if v[0]}
    nodes, edges = traverse.k_hop(g, seeds(spark, 3), 2, direction="both")
    want = bfs(steps(g, "both"), [3], 2)
    assert {r.internal_id: r.depth for r in nodes.collect()} == {k: d for k, (d, _) in want.items()}
    assert {r.eid for r in edges.collect()} == {e[3] for e in steps(g, "both") if want.get(e[0], (9,))[0] < 2}
    assert traverse.neighbors(g, seeds(spark, 3), ["none"], depth=2).collect() == []


def test_paths(spark, g):
    edges = steps(g)
    adj = g.adjacency()
    for s in (0, 3):
        want = all_paths(edges, s, 3)
        got = traverse.simple_paths(adj, seeds(spark, s), None, 3).collect()
        assert sorted((tuple(r.nodes), tuple(r.eids)) for r in got) == sorted(want)
        ends = spark.createDataFrame([(5,), (8,)], "gid long")
        got = traverse.simple_paths(adj, seeds(spark, s), ends, 3).collect()
        assert sorted((tuple(r.nodes), tuple(r.eids)) for r in got) == sorted(p for p in want if p[0][-1] in (5, 8))
        for t in (5, 8):
            best = min(((len(e), n, e) for n, e in all_paths(edges, s, 11) if n[-1] == t), default=None)
            found = [(r.depth, tuple(r.nodes), tuple(r.eids)) for r in traverse.shortest_path(g, s, t).collect()]
            assert found == ([best] if best else [])
    assert traverse.paths(g, 3, 3).collect() == []
    with pytest.raises(GraphError):
        traverse.simple_paths(adj, seeds(spark, 0), None, 0)
    with pytest.raises(GraphError):
        traverse.reachable(adj, seeds(spark, 0), 2, 1)


def test_sampling(spark, g):
    rows = traverse.sample_layers(g, seeds(spark, 3, 7), [2, 1], ["r", "s"], seed=5).collect()
    assert rows == traverse.sample_layers(g, seeds(spark, 3, 7), [2, 1], ["r", "s"], seed=5).collect() or sorted(rows) == sorted(traverse.sample_layers(g, seeds(spark, 3, 7), [2, 1], ["r", "s"], seed=5).collect())
    known = {(e[0], e[1], e[2], e[3]) for e in steps(g)}
    per = {}
    for r in rows:
        assert (r.src, r.dst, r.edge_type, r.eid) in known
        per[r.layer, r.src, r.edge_type] = per.get((r.layer, r.src, r.edge_type), 0) + 1
    assert all(n <= (2, 1)[layer] for (layer, _, _), n in per.items())
    walks = {}
    for r in traverse.random_walks(g, seeds(spark, 3), 3, 4, p=0.5, q=2.0).collect():
        walks.setdefault(r.walk_id, {})[r.step] = r.gid
    pairs = {(e[0], e[1]) for e in steps(g)}
    assert len(walks) == 4
    assert all((w[i], w[i + 1]) in pairs for w in walks.values() for i in range(len(w) - 1))


def test_closures_and_algebra(spark, g):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (None, 1)], "src long, dst long")
    added, _ = ontology.transitive_edges(e)
    assert sorted(map(tuple, added.collect())) == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 2), (3, 3)]
    assert sorted(map(tuple, ontology.symmetric_edges(e).collect())) == [(1, 3), (2, 1), (3, 2)]
    with pytest.raises(GraphError):
        ontology.transitive_edges(e, budget=2)
    people = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (None, "N")], "id long, name string")
    orders = spark.createDataFrame([(10, 1), (11, 2), (12, 1), (13, 4), (14, None)], "oid long, buyer long")
    rows = lambda kind: sorted(((r.name or "-", r.oid) for r in algebra.hash_join(people, orders, "id", "buyer", kind).collect()))
    assert rows("inner") == [("A", 10), ("A", 12), ("B", 11), ("N", 14)]
    assert rows("left") == [("-", 13), ("A", 10), ("A", 12), ("B", 11), ("N", 14)]
    v = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 1.0)], "i long, v double")
    assert [r.i for r in algebra.top_k(v, [("v", True)]).collect()] == [1, 4, 3, 2]
    assert [r.i for r in algebra.top_k(v, [("v", False)], 2, 1).collect()] == [1, 3]
    assert algebra.hash_aggregate(v.limit(0), [], [(None, "count_star", "n")]).collect() == [(0,)]
    for bad in (lambda: algebra.hash_join(people, orders, "id", "buyer", "full"), lambda: algebra.hash_aggregate(v, [], [("v", "nope", "x")]), lambda: algebra.top_k(v, [], -1)):
        with pytest.raises(GraphError):
            bad()


def test_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = rows[7][1]
    dist = sorted((sum((a - b) ** 2 for a, b in zip(v, q, strict=True)) ** 0.5, i) for i, v in rows if v)
    assert [x.id for x in vector.knn(df, "id", "v", q, 5, "l2").orderBy("rank").collect()] == [i for _, i in dist[:5]]
    got = {}
    for x in vector.knn_join(df, df.where("id % 100 = 0 and id < 1000"), "id", "v", 3, block=2).collect():
        got.setdefault(x.query, []).append((x["rank"], x.id))
    for i in (0, 100, 200):
        want = [x.id for x in vector.knn(df.where(f"id <> {i}"), "id", "v", rows[i][1], 3).orderBy("rank").collect()]
        assert [x for _, x in sorted(got[i])] == want
    index = vector.InvertedFile(df, "id", "v", lists=8)
    hits = sum(len({x.id for x in index.search(rows[i][1], 10, probes=6).collect()} & {x.id for x in vector.knn(df, "id", "v", rows[i][1], 10).collect()}) for i in range(0, 50, 10))
    assert hits >= 0.9 * 50


def test_text_and_evidence(spark):
    nodes = spark.createDataFrame([(1, "e1", "Sam Bankman-Fried", ["SBF", "Sam B."]), (2, "e2", "Sam Smith", []), (3, "e3", None, ["Alameda"])], "gid long, node_id string, canonical_name string, aliases array<string>")
    entries = text.text_entries(nodes, ["canonical_name", "aliases"])
    found = [(r.gid, r.kind, r.score) for r in text.text_search(entries, "Sam Bankman Fried", 5).orderBy("rank").collect()]
    assert found == [(1, "normalized", 3.5), (2, "partial", pytest.approx(1 + 0.5 / 3))]
    assert text.text_search(entries, "!!", 5).collect() == []
    chunks = spark.createDataFrame([(10, "c1"), (11, "c2")], "gid long, node_id string")
    edges = {"M": spark.createDataFrame([(1, 1, 10, 0.5), (2, 1, 2, 0.8), (3, 2, 11, 0.75)], "eid long, src long, dst long, weight double")}
    g = PropertyGraph(spark, {"Entity": nodes, "Chunk": chunks}, edges)
    start = spark.createDataFrame([(0, 1, 1.0)], "pos long, gid long, seed_score double")
    rows = retrieve.evidence_search(g, start, direction="out").orderBy("rank").collect()
    assert [(r.target, r.depth, round(r.score, 6)) for r in rows] == [(10, 1, round(0.55 * 0.5 + 0.3 - 0.15, 6)), (11, 2, round(0.55 * 0.6 + 0.3 - 0.3, 6))]
    links = retrieve.link_entities(g, "SBF", entries, 3).collect()
    assert links[0].gid == 1
    assert links[0].lexical_score == pytest.approx(4.0 * 0.9)
