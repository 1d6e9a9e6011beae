import pytest

from grafloom.database import Database
from grafloom.errors import GraphError
from grafloom.sources import export, ingest


def ids(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows)


@pytest.fixture(scope="module")
def db(spark):
    d = Database(spark)
    d.insert_node_table([{"node_id": i, "type": t, "name": n, "w": w} for i, t, n, w in (("g1", "Plant", "alder", 1.0), ("g2", "Plant", "birch", 2.0), ("g3", "Plant", "cedar", None), ("t1", "Plot", "north", 3.0), ("t2", "Plot", "south", 4.0))])
    d.insert_edge_table([{"src": s, "dst": t, "type": "grows_in", "weight": w} for s, t, w in (("g1", "t1", 0.5), ("g1", "t2", 0.7), ("g2", "t1", 0.9))])
    return d


def test_query_language(db):
    rows = db.sql("MATCH (g:Plant)-[:grows_in]->(t:Plot) RETURN g.name, t.name AS plot ORDER BY plot").rows()
    assert ids(rows, "name", "plot") == [("alder", "north"), ("alder", "south"), ("birch", "north")]
    assert db.sql('MATCH (g:Plant) WHERE g.name = $n RETURN degree(g, "grows_in") AS d', {"n": "alder"}).rows() == [{"d": 2}]
    assert db.sql("MATCH (g:Plant) RETURN g.w ORDER BY w DESC LIMIT 2").rows() == [{"w": 2.0}, {"w": 1.0}]
    assert db.sql("MATCH (g:Plant) WHERE g.w > 100 RETURN count(*) AS n").rows() == [{"n": 0}]
    for bad, code in (("MATCH (g:Nope) RETURN g", 6070), ("MATCH (g:Plant)-[:nope]->(x) RETURN g", 6023), ("MATCH (g:Plant) RETURN g.nope", 6020), ("MATCH (g:Plant)", 6020), ("MATCH (g:Plant RETURN g", 2001), ("MATCH (g) WHERE # RETURN g", 1001)):
        with pytest.raises(GraphError) as e:
            db.sql(bad)
        assert e.value.code == code, bad


def test_fluent_and_predicates(db):
    assert db.nodes("Plant").where(w=None).select("name").rows() == [{"name": "cedar"}]
    assert db.nodes("Plant").where(name="alder").count() == 1
    assert db.query_nodes("Plant", "w >= 2").count() == 1
    assert db.query_nodes("Plant", "name = 'alder'", "w").first()["w"] == 1.0
    with pytest.raises(GraphError):
        db.query_nodes("Plant", "name ~ x")
    assert db.resource("t1").node_type == "Plot"
    with pytest.raises(GraphError):
        db.resource("zzz")
    assert "alder" in export.turtle(db.graph, "g1")
    assert "grows_in" in export.turtle(db.graph, "g1")


def test_unknown_ends(db):
    with pytest.raises(GraphError) as e:
        db.insert_edge_table([{"src": "g1", "dst": "nope", "type": "grows_in", "weight": 1.0}])
    assert e.value.code == 7021


def test_upsert_keeps_ids_and_old_snapshots(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"))
    d.insert_node_table([{"node_id": "a", "type": "E", "name": "A", "x": 1}, {"node_id": "b", "type": "E", "name": "B", "x": 2}])
    gid = {r["node_id"]: r["gid"] for r in d.node_table("E").collect()}
    d.create_snapshot("before")
    assert d.upsert_node_table([{"node_id": "a", "type": "E", "name": "A2"}, {"node_id": "c", "type": "E", "name": "C"}]) == {"inserted": 1, "updated": 1, "skipped": 0, "failed": 0}
    now = {r["node_id"]: (r["gid"], r["name"], r["x"]) for r in d.node_table("E").collect()}
    assert now["a"] == (gid["a"], "A2", 1)
    assert now["b"] == (gid["b"], "B", 2)
    assert now["c"][1:] == ("C", None)
    assert ids([r.asDict() for r in d.graph.at("before").nodes("E").collect()], "name") == [("A",), ("B",)]
    assert d.upsert_node_table([{"node_id": "a", "type": "E", "name": "A3"}], update_existing=False) == {"inserted": 0, "updated": 0, "skipped": 1, "failed": 0}
    d.upsert_edge_table([{"src": "a", "dst": "b", "type": "R", "weight": 0.1}])
    assert d.upsert_edge_table([{"src": "a", "dst": "b", "type": "R", "weight": 0.2}, {"src": "b", "dst": "c", "type": "R", "weight": 0.3}]) == {"inserted": 1, "updated": 1, "skipped": 0, "failed": 0}
    assert sorted((r["eid"], r["weight"]) for r in d.edge_table("R").collect()) == [(0, 0.2), (1, 0.3)]
    again = Database(spark, str(tmp_path / "db"))
    assert again.sql("MATCH (a:E)-[r:R]->(b:E) RETURN a.name AS a, b.name AS b, r.weight AS w").df.count() == 2
    n = export.pack(str(tmp_path / "db"), str(tmp_path / "x.zip"))
    assert n > 3
    assert export.is_packed(str(tmp_path / "x.zip"))
    export.unpack(str(tmp_path / "x.zip"), str(tmp_path / "copy"))
    copy = Database(spark, str(tmp_path / "copy"))
    assert not any(r["only_a"] or r["only_b"] for r in export.diff(d.graph, copy.graph).collect())
    with pytest.raises(GraphError):
        d.create_snapshot("before")


def test_statements(spark):
    d = Database(spark)
    d.execute("CREATE CLASS Organ; CREATE CLASS Liver SUBCLASSOF Organ PROPERTIES (name STRING REQUIRED); CREATE PROPERTY knows TYPE OBJECT CHARACTERISTICS (SYMMETRIC, TRANSITIVE); INSERT Liver { name: 'l1' }; INSERT Liver { name: 'l2' }")
    d.execute("INSERT Organ { name: 'o1' }")
    rows = d.sql("MATCH (o:Organ) WHERE o.class SUBCLASSOF* Organ RETURN o.name, o.class_iri").rows()
    assert ids(rows, "name", "class_iri") == [("l1", "local:Liver"), ("l2", "local:Liver"), ("o1", "local:Organ")]
    with pytest.raises(GraphError):
        d.execute("INSERT Liver { other: 'x' }")
    d.insert_triples([("employee/E1", "rdf:type", "Employee"), ("employee/E1", "name", "Ann"), ("employee/E1", "knows", "employee/E2"), ("employee/E2", "knows", "person/P3")])
    assert d.catalog.ancestors("Liver") == ["Liver", "Organ"]
    assert d.node_table("Employee").where("node_id = 'employee/E1'").first()["name"] == "Ann"
    report = d.infer_closure(["knows"])["knows"]
    pairs = {(r["src"], r["dst"]) for r in d.edge_table("knows").collect()}
    assert len(pairs) == 9
    assert report["added"] == 7
    assert "MATCH".lower() in d.execute("EXPLAIN MATCH (o:Organ) RETURN o.name")[0]["clauses"]
    assert d.profile("MATCH (o:Organ) RETURN o.name")["rows"] == 1


def test_ntriples(spark, tmp_path):
    f = tmp_path / "x.nt"
    f.write_text('<http://x/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/Person> .\n# note\n<http://x/a> <http://x/name> "An\\"n"@en .\n<http://x/a> <http://x/knows> <http://x/b> .\n_:q <http://x/knows> <http://x/b> .\n')
    d = Database(spark)
    assert d.import_ntriples(str(f)) == {"nodes": 2, "edges": 1, "skipped": 1, "replaced": 0}
    assert d.node_table("Person").first()["name"] == 'An"n'
    f.write_text("nonsense\n")
    with pytest.raises(GraphError) as e:
        d.import_ntriples(str(f))
    assert e.value.code == 7050


def test_parquet_with_bad_rows(spark, tmp_path):
    spark.createDataFrame([("1", "2", "x"), ("-1", "2", "y"), ("z", "3", "q"), (None, "3", "q")], "a string, dst string, p string").write.parquet(str(tmp_path / "e"))
    good, bad = ingest.edges_from_parquet(spark, str(tmp_path / "e"), {"a": "src"})
    assert [(r.src, r.dst) for r in good.collect()] == [(1, 2)]
    assert bad.count() == 3
    with pytest.raises(GraphError):
        ingest.edges_from_parquet(spark, str(tmp_path / "e"))
    good, bad = ingest.nodes_from_parquet(spark, str(tmp_path / "e"), types={"a": "int"})
    assert (good.count(), bad.count()) == (3, 1)


def test_indexes(db, spark):
    d = Database(spark)
    d.insert_node_table([{"node_id": f"c{i}", "type": "Chunk", "source_type": s, "embedding": v} for i, (s, v) in enumerate([("document", [1.0, 0.0, 0.0]), ("web", [0.0, 1.0, 0.0]), ("document", [0.9, 0.1, 0.0])])])
    d.create_vector_index("v", "Chunk", "embedding", 3)
    d.create_vector_index("v", "Chunk", "embedding", 3)
    with pytest.raises(GraphError):
        d.create_vector_index("v", "Chunk", "embedding", 3, "l2")
    with pytest.raises(GraphError):
        d.create_vector_index("w", "Chunk", "embedding", 4)
    assert [r.node_id for r in d.vector_search("v", [1.0, 0.0, 0.0], 3, {"source_type": "document"}).orderBy("rank").collect()] == ["c0", "c2"]
    rows = d.sql("CALL vector.search('v', [1.0, 0.0, 0.0], 2) YIELD node_id, score, rank RETURN node_id, rank ORDER BY rank").rows()
    assert [r["node_id"] for r in rows] == ["c0", "c2"]
    db.create_text_index("t", "Plant", ["name"])
    assert db.text_search("t", "Alder", 3).first()["kind"] == "normalized"
    db.create_property_index("p", "Plant", "name")
    assert db.property_lookup("p", "cedar").count() == 1
    assert [i.name for i in db.list_indexes()] == ["t", "p"]
    db.drop_index("p")
    with pytest.raises(GraphError):
        db.drop_index("p")


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_insert_refuses_rows_without_key(spark):
    d = Database(spark)
    for bad in ([{"node_id": "a", "type": "E"}, {"node_id": None, "type": "E"}], [{"node_id": "a", "type": None}, {"node_id": "b", "type": "E"}]):
        with pytest.raises(GraphError) as e:
            d.insert_node_table(bad)
        assert e.value.code == 7011
    assert d.tables == {}
    assert d.upsert_node_table([{"node_id": "a", "type": "E"}, {"node_id": None, "type": "E"}]) == {"inserted": 1, "updated": 0, "skipped": 0, "failed": 1}


def test_the_later_of_repeated_rows_counts(spark):
    d = Database(spark)
    d.insert_node_table([{"node_id": "r", "type": "E", "x": 5.0}, {"node_id": "s", "type": "E", "x": 5.0}])
    assert d.upsert_node_table([{"node_id": "r", "type": "E", "x": 9.0}, {"node_id": "r", "type": "E", "x": 1.0}, {"node_id": "n", "type": "E", "x": 2.0}, {"node_id": "n", "type": "E", "x": 1.0}]) == {"inserted": 1, "updated": 3, "skipped": 0, "failed": 0}
    assert rows_of(d.node_table("E"), "node_id", "x") == [("n", 1.0), ("r", 1.0), ("s", 5.0)]
    edges = [{"src": "r", "dst": "s", "type": "R", "weight": w} for w in (9.0, 1.0)]
    assert d.upsert_edge_table(edges) == {"inserted": 1, "updated": 1, "skipped": 0, "failed": 0}
    assert d.upsert_edge_table([*edges[::-1], {"src": "r", "dst": "zzz", "type": "R", "weight": 1.0}]) == {"inserted": 0, "updated": 2, "skipped": 0, "failed": 1}
    assert rows_of(d.edge_table("R"), "eid", "weight") == [(0, 9.0)]


def test_a_key_that_changes_class_moves(spark):
    d = Database(spark)
    d.insert_node_table([{"node_id": "a", "type": "E", "x": 1, "only": "e"}, {"node_id": "b", "type": "F", "x": 2}])
    gid = d.resource("a").gid
    d.create_snapshot("before")
    assert d.upsert_node_table([{"node_id": "a", "type": "F", "x": 7}]) == {"inserted": 0, "updated": 1, "skipped": 0, "failed": 0}
    assert rows_of(d.node_table("E"), "node_id") == []
    assert rows_of(d.node_table("F").na.fill("-"), "node_id", "x", "only", "gid") == [("a", 7, "e", gid), ("b", 2, "-", d.resource("b").gid)]
    assert rows_of(d.at("before").nodes("E"), "node_id", "x") == [("a", 1)]


def test_triples_keep_classes_and_count_replaced_values(spark):
    d = Database(spark)
    assert d.insert_triples([("e/1", "a", "Person"), ("e/1", "tag", "x"), ("e/1", "tag", "y"), ("e/1", "tag", "w")]) == {"nodes": 1, "edges": 0, "replaced": 2}
    assert d.insert_triples([("q/2", "knows", "e/1")]) == {"nodes": 2, "edges": 1, "replaced": 0}
    assert rows_of(d.graph.node_index(), "node_id", "node_type") == [("e/1", "Person"), ("q/2", "Q")]
    assert rows_of(d.node_table("Person"), "node_id", "tag", "_placeholder") == [("e/1", "w", False)]
    d.execute('INSERT TRIPLES { e:x3 a Person . e:x3 tag "z" . e:x3 knows e:x4 . }')
    assert d.node_table("Person").count() == 2
    assert d.edge_table("knows").count() == 2


def test_appends_rewrite_nothing(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "db").rglob("*.parquet")}
    d.insert_node_table([{"node_id": f"n{i}", "type": "E", "x": i} for i in range(50)])
    for batch in ([{"node_id": "n1", "type": "E", "x": -1}], [{"node_id": "m", "type": "E", "y": "new"}], [{"node_id": "n1", "type": "E", "x": -2}]):
        before = files()
        d.upsert_node_table(batch)
        assert before.items() <= files().items()
    got = {r["node_id"]: (r["x"], r["y"]) for r in Database(spark, str(tmp_path / "db")).node_table("E").collect()}
    assert len(got) == 51
    assert (got["n1"], got["n2"], got["m"]) == ((-2, None), (2, None), (None, "new"))
    d.store.compact("nodes/E")
    d.commit()
    assert {r["node_id"]: (r["x"], r["y"]) for r in Database(spark, str(tmp_path / "db")).node_table("E").collect()} == got
    assert d.graph.at(1).nodes("E").where("node_id = 'n1'").first()["x"] == 1


def test_transactions(spark, tmp_path):
    d = Database(spark, str(tmp_path / "db"))
    d.insert_node_table([{"node_id": "a", "type": "E", "x": 1}])
    d.begin()
    d.upsert_node_table([{"node_id": "a", "type": "E", "x": 2}])
    assert Database(spark, str(tmp_path / "db")).node_table("E").first()["x"] == 1
    d.rollback()
    assert d.node_table("E").first()["x"] == 1
    other = Database(spark, str(tmp_path / "db"))
    d.begin()
    d.upsert_node_table([{"node_id": "a", "type": "E", "x": 3}])
    other.upsert_node_table([{"node_id": "a", "type": "E", "x": 4}])
    with pytest.raises(GraphError) as e:
        d.commit_transaction()
    assert e.value.code == 8002
    assert d.node_table("E").first()["x"] == 1
    assert Database(spark, str(tmp_path / "db")).node_table("E").first()["x"] == 4
    with pytest.raises(GraphError):
        d.rollback()
    d = Database(spark, str(tmp_path / "db"))
    with d.transaction():
        d.upsert_node_table([{"node_id": "a", "type": "E", "x": 5}])
    with pytest.raises(ZeroDivisionError), d.transaction():
        d.upsert_node_table([{"node_id": "a", "type": "E", "x": 6}])
        1 / 0  # noqa: B018
    assert Database(spark, str(tmp_path / "db")).node_table("E").first()["x"] == d.node_table("E").first()["x"] == 5


def test_loading_files_with_bad_rows(spark, tmp_path):
    spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "node_id string, n string").write.parquet(str(tmp_path / "n"))
    d = Database(spark)
    with pytest.raises(GraphError):
        d.ingest_nodes_from_parquet("E", str(tmp_path / "n"), types={"n": "int"}, max_rejected=0)
    r = d.ingest_nodes_from_parquet("E", str(tmp_path / "n"), types={"n": "int"})
    assert (r["accepted"], r["rejected"], r["quarantine"].first()["node_id"]) == (2, 1, "b")
    gids = [x["gid"] for x in d.node_table("E").collect()]
    spark.createDataFrame([(gids[0], gids[1]), (None, 1)], "src long, dst long").write.parquet(str(tmp_path / "e"))
    r = d.ingest_edges_from_parquet("R", str(tmp_path / "e"))
    assert (r["accepted"], r["rejected"], d.edge_table("R").count()) == (1, 1, 1)


def test_import_policies(spark):
    d = Database(spark)
    assert d.import_resources([{"id": "a", "type": "E", "x": 1}, {"src": "a", "dst": "b", "type": "R"}, {"labels": ["E"], "id": "b", "properties": {"x": 2}}, ("b", "likes", "a/c")]) == {"nodes": 4, "edges": 2}
    assert d.import_resource({"id": "a", "type": "E", "x": 5}, "skip") == {"nodes": 0, "edges": 0}
    with pytest.raises(GraphError):
        d.import_resource({"id": "a", "type": "E", "x": 5}, "error")
    assert d.node_table("E").where("node_id = 'a'").first()["x"] == 1


def test_statements_that_change_rows(spark, tmp_path):
    d = Database(spark)
    d.insert_node_table([{"node_id": i, "type": t, "x": x, "tag": None} for i, t, x in (("a", "E", 1), ("b", "E", 2), ("c", "E", 3), ("z", "F", 9))])
    d.insert_edge_table([{"src": s, "dst": t, "type": r, "weight": w} for s, t, r, w in (("a", "b", "R", 0.1), ("b", "c", "R", 0.2), ("b", "z", "S", 0.3))])
    assert d.execute("MATCH (e:E)-[:R]->(f:E) WHERE e.x < 2 SET e.x = f.x + 10, e.tag = 'new'") == [1]
    assert rows_of(d.node_table("E").na.fill("-"), "node_id", "x", "tag") == [("a", 12, "new"), ("b", 2, "-"), ("c", 3, "-")]
    assert d.execute("MATCH (a)-[r:R]->(b) SET r.weight = $w", {"w": 5}) == [2]
    assert rows_of(d.edge_table("R"), "weight") == [(5.0,), (5.0,)]
    assert d.execute("MATCH (a:E)-[r:S]->(b) DELETE r") == [1]
    assert d.edge_table("S").count() == 0
    assert d.execute("MATCH (e:E) WHERE e.x = 2 DETACH DELETE e") == [1]
    assert d.edge_table("R").count() == 0
    assert d.graph.at(1).nodes("E").count() == 3
    assert d.execute("MERGE (e:E {node_id: 'q'}) ON CREATE SET e.x = 7 ON MATCH SET e.x = 8") == [{"created": 1, "matched": 0}]
    assert d.execute("MERGE (e:E {node_id: 'q'}) ON CREATE SET e.x = 7 ON MATCH SET e.x = 8") == [{"created": 0, "matched": 1}]
    assert d.node_table("E").where("node_id = 'q'").first()["x"] == 8
    d.execute("BEGIN; MERGE (e:E {node_id: 'r'}); ROLLBACK; BEGIN; MERGE (e:E {node_id: 's'}); COMMIT")
    assert rows_of(d.node_table("E"), "node_id") == [("a",), ("c",), ("q",), ("s",)]
    with pytest.raises(GraphError):
        d.execute("MATCH (e:E) SET e.gid = 1")
    assert d.execute("CREATE INDEX ON E(x) USING BTREE")[0].name == "E_x_btree"
    assert rows_of(d.property_lookup("E_x_btree", 8), "node_id") == [("q",)]
    assert rows_of(d.property_lookup("E_x_btree", None), "node_id") == [("s",)]
    assert not d.is_stale("E_x_btree")
    d.execute("MATCH (e:E) WHERE e.node_id = 's' SET e.x = 8")
    assert d.is_stale("E_x_btree")
    assert rows_of(d.property_lookup("E_x_btree", 8), "node_id") == [("q",), ("s",)]
    d.execute("DROP INDEX E_x_btree")
    assert d.execute(f"EXPORT SUBGRAPH AS PARQUET NODES(E) EDGES(R) TO '{tmp_path}/out'") == [["nodes/E", "edges/R"]]
    assert spark.read.parquet(f"{tmp_path}/out/nodes/E").count() == 4


def test_sets_of_queries_and_distinct_aggregates(spark):
    d = Database(spark)
    d.insert_node_table([{"node_id": f"n{i}", "type": t, "x": x} for i, (t, x) in enumerate([("E", 1), ("E", 1), ("E", 3), ("E", None), ("F", 3)])])
    one = lambda q: sorted(tuple(r.values()) for r in d.sql(q).rows())
    assert one("MATCH (e:E) RETURN avg(DISTINCT e.x) AS a, sum(DISTINCT e.x) AS s, count(DISTINCT e.x) AS n, stddev(DISTINCT e.x) AS d, percentile(DISTINCT e.x, 0.5) AS p") == [(2.0, 4, 2, 2**0.5, 2.0)]
    assert sorted(map(str, d.sql("MATCH (e:E) RETURN collect(DISTINCT e.x) AS c").rows()[0]["c"])) == ["1", "3", "None"]
    assert sorted(str(r["x"]) for r in d.sql("MATCH (e:E) RETURN e.x AS x UNION MATCH (f:F) RETURN f.x AS y").rows()) == ["1", "3", "None"]
    assert len(d.sql("MATCH (e:E) RETURN e.x AS x UNION ALL MATCH (f:F) RETURN f.x AS y").rows()) == 5
    assert one("MATCH (e:E) RETURN e.x AS x INTERSECT MATCH (f:F) RETURN f.x AS x") == [(3,)]
    assert one("MATCH (e:E) WHERE e.x > 0 RETURN e.x AS x EXCEPT MATCH (f:F) RETURN f.x AS x") == [(1,)]
    assert one("MATCH (n) WHERE n.x = 3 RETURN n.node_id AS i, n.node_type AS t") == [("n2", "E"), ("n4", "F")]


def test_subproperties(spark):
    d = Database(spark)
    d.catalog.define_property("related")
    d.catalog.define_property("likes", parents=["related"])
    d.insert_node_table([{"node_id": i, "type": "E"} for i in "abc"])
    d.insert_edge_table([{"src": s, "dst": t, "type": r} for s, t, r in (("a", "b", "likes"), ("b", "c", "hates"), ("a", "c", "related"))])
    rows = d.sql("MATCH (a)-[r]->(b) WHERE type(r) SUBPROPERTYOF* related RETURN a.node_id AS a, b.node_id AS b").rows()
    assert ids(rows, "a", "b") == [("a", "b"), ("a", "c")]
