"""Graph questions to a database by external id."""

import pytest

from grafloom.database import Database
from grafloom.errors import GraphError


@pytest.fixture(scope="module")
def db(spark):
    d = Database(spark)
    nodes = [("p1", "Person", "Ada North", ["Ada"], None), ("p2", "Person", "Ben West", ["B. W."], None), ("k1", "Chunk", None, [], [1.0, 0.0, 0.0]), ("k2", "Chunk", None, [], [0.0, 1.0, 0.0]), ("k3", "Chunk", None, [], [0.6, 0.8, 0.0])]
    d.insert_node_table([{"node_id": i, "type": t, "canonical_name": n, "aliases": a, "embedding": e, "source": f"s-{i}"} for i, t, n, a, e in nodes])
    edges = [("p1", "p2", "KNOWS", 0.5), ("p2", "k2", "IN", 0.9), ("p1", "k1", "IN", 0.2), ("k1", "p2", "NAMES", 0.8), ("p1", "k3", "IN", 0.7), ("k3", "p1", "NAMES", 0.1)]
    d.insert_edge_table([{"src": s, "dst": t, "type": r, "weight": w} for s, t, r, w in edges])
    d.create_text_index("names", "Person", ["canonical_name", "aliases"])
    d.create_vector_index("chunks", "Chunk", "embedding", 3)
    return d


def gid(db, name):
    return db.resource(name).gid


def test_adjacency_and_degrees(db):
    assert sorted(r.dst for r in db.out("p1", "IN").collect()) == sorted(gid(db, k) for k in ("k1", "k3"))
    assert [(r.src, r.dst) for r in db.in_("p2", "KNOWS").collect()] == [(gid(db, "p1"), gid(db, "p2"))]
    assert db.out("p1", "IN", return_eids=True).columns == ["src", "dst", "eid"]
    assert db.out("p1", "no_such").collect() == []
    assert db.degree("p1", "IN") == 2
    assert db.degree("p1", "NAMES", "both") == 1
    assert {r.node_id: r.degree for r in db.degree(["p1", "k2"], "IN", "both").collect()} == {gid(db, "p1"): 2, gid(db, "k2"): 1}
    assert [r.node_id for r in db.common_neighbors("p1", "k1", "IN", "both").collect()] == []
    assert [r.node_id for r in db.common_neighbors("k1", "k3", "IN", "in").collect()] == [gid(db, "p1")]
    assert [(r.node_id, r.overlap) for r in db.overlap("k1", ["k3", "k2"], "IN", "in", top_k=1).collect()] == [(gid(db, "k3"), 1)]
    for bad in (lambda: db.degree("zz", "IN"), lambda: db.degree("p1", "IN", "up"), lambda: db.overlap("k1", ["k2"], "IN", top_k=-1)):
        with pytest.raises(GraphError):
            bad()


def test_neighbors_and_k_hop(db):
    rows = db.neighbors(["p1"], ["KNOWS", "IN"], depth=2, edge_filters={"weight_gte": 0.5}, return_paths=True, return_properties=["source"]).rows()
    assert [(r["node_id"], r["depth"], r["path_node_ids"], r["path_edge_types"], r["source"]) for r in rows] == [("k3", 1, ["p1", "k3"], ["IN"], "s-k3"), ("p2", 1, ["p1", "p2"], ["KNOWS"], "s-p2"), ("k2", 2, ["p1", "p2", "k2"], ["KNOWS", "IN"], "s-k2")]
    assert [r["node_id"] for r in db.neighbors("p1", ["IN"], top_edges_per_node=1).rows()] == ["k3"]
    assert [r["node_id"] for r in db.neighbors("p1", None, depth=2, path_score="product", order_by_score="desc", limit=2).rows()] == ["k3", "p2"]
    near = db.k_hop("p1", 1, ["IN"], "out")
    assert [r.node_id for r in near["nodes"].collect()][0] == "p1"
    assert near["edges"].count() == 2


def test_paths(db):
    rows = db.paths("p1", "p2", ["KNOWS", "IN", "NAMES"], max_depth=2, score="sum").rows()
    assert [(r["node_ids"], r["relation_types"], round(r["path_score"], 6)) for r in rows] == [(["p1", "k1", "p2"], ["IN", "NAMES"], 1.0), (["p1", "p2"], ["KNOWS"], 0.5)]
    assert '"weight":0.2' in rows[0]["edge_properties"][0]
    assert db.shortest_path("p1", "k2")["node_ids"] == ["p1", "p2", "k2"]
    assert db.shortest_path("p1", "p1") == {"depth": 0, "internal_node_ids": [gid(db, "p1")], "edge_ids": [], "node_ids": ["p1"]}
    assert db.shortest_path("k2", "p1", ["IN"]) is None
    rows = db.paths(sources=["p1", "p2"], target_node_types=["Chunk"], max_depth=2, max_paths_per_seed=None, return_properties=["source"]).rows()
    assert [(r["path_node_ids"], round(r["score"], 6), r["source"]) for r in rows][:2] == [(["p2", "k2"], 0.9, "s-k2"), (["p1", "k3"], 0.7, "s-k3")]
    assert len(rows) == 4
    for bad in ({"source": "p1"}, {"sources": ["p1"]}, {"target_node_types": ["Chunk"]}):
        with pytest.raises(GraphError):
            db.paths(**bad)


def test_retrieval(db):
    linked = db.link_entities("ada north", "names", top_k=2, return_properties=["source"]).rows()
    assert [(r["node_id"], r["source"]) for r in linked] == [("p1", "s-p1")]
    assert db.link_entities("nothing", "names").rows() == []
    by_vector = db.link_entities("x", vector_index="chunks", query_vector=[0.0, 1.0, 0.0], top_k=1).rows()
    assert by_vector[0]["node_id"] == "k2"
    found = db.vector_search("chunks", [1.0, 0.0, 0.0], 1, boosts=[{"signal": "mentions_entity", "entities": ["p2"], "weight": 3.0}], return_properties=["source"]).collect()
    assert [(r.node_id, r.source) for r in found] == [("k1", "s-k1")]
    assert [r.node_id for r in db.vector_search("chunks", [0.0, 1.0, 0.0], 2, probes=99).orderBy("rank").collect()] == ["k2", "k3"]
    rows = db.evidence_search(["p2", "p1"], "Chunk", ["KNOWS", "IN"], "out", seed_scores={"p1": 0.1}, return_properties=["source"]).rows()
    assert list(rows[0])[:7] == ["target_node_id", "target_node_type", "score", "rank", "depth", "source_seed_id", "source_seed_type"]
    assert [(r["target_node_id"], r["source_seed_id"], r["path_node_ids"], r["source"]) for r in rows][0] == ("k2", "p2", ["p2", "k2"], "s-k2")
    result = db.graphrag_search("Ada North", [1.0, 0.0, 0.0], "chunks", "names", ["IN", "KNOWS"], return_properties=["source"])
    assert result.entity_links.rows()[0]["node_id"] == "p1"
    assert result.evidence_chunks.rows()[0]["chunk_id"] in ("k1", "k3")
    assert len(result.citation_candidates.rows()) == 3
    assert {r["target_node_id"] for r in result.paths.rows()} <= {"k1", "k2", "k3"}
    for bad in (lambda: db.link_entities("x"), lambda: db.vector_search("chunks", [1.0], 1), lambda: db.text_hits("chunks", "x")):
        with pytest.raises((GraphError, KeyError)):
            bad()


def test_learning(db):
    index, ids = db.sample_gnn_subgraph(["p1"], [5], ["IN"], strategy="first")
    assert ids.tolist() == [gid(db, "p1"), *sorted(gid(db, k) for k in ("k1", "k3"))]
    assert index.tolist() == [[0, 0], [1, 2]] or index.tolist() == [[0, 0], [2, 1]]
    index, ids = db.sample_gnn_subgraph([gid(db, "p1")], [5], ["IN"], id_space="internal", strategy="first", max_edges=1, max_nodes=2)
    assert (index.shape, len(ids)) == ((2, 1), 2)
    index, _ = db.sample_gnn_subgraph(["p1"], [6], ["IN"], replace=True, seed=4)
    assert index.shape == (2, 6)
    assert [len(n) for _, n in db.neighbor_loader("Chunk", [1], ["NAMES"], batch_size=2)] == [4, 1]
    with pytest.raises(GraphError):
        db.sample_gnn_subgraph(["p1"], [5], ["IN"], id_space="other")


def test_snapshots(db):
    db.create_snapshot("s1")
    assert db.list_snapshots() == {"s1": db.lsn}
    db.release_snapshot("s1")
    assert db.list_snapshots() == {}
    with pytest.raises(GraphError):
        db.release_snapshot("s1")


def test_indexes_are_stored_and_follow_changes(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"))
    d.insert_node_table([{"node_id": f"n{i}", "type": "E", "name": f"word{i % 40} common"} for i in range(200)])
    d.create_text_index("t", "E", ["name"])
    assert d.text_hits("t", "word7").count() == 5
    assert len(list((tmp_path / "db" / "indexes").iterdir())) == 1
    d.upsert_node_table([{"node_id": "n7", "type": "E", "name": "other"}])
    assert d.is_stale("t")
    assert d.text_hits("t", "Word7!").count() == 4
    assert d.text_hits("t", "common").count() == 199
    assert [r.text for r in d.text_search("t", "other", 3).collect()] == ["other"]
