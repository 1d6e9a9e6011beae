import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from grafloom import cli
from grafloom.database import Database
from grafloom.errors import GraphError
from grafloom.functions.udf import UdfRegistry
from grafloom.graph import PropertyGraph
from grafloom.operators.features import FeatureView, gnn_subgraph, neighbor_loader
from grafloom.sources import export, ingest
from grafloom.streaming.ingest import read_folder, sessions, upsert_nodes, windowed


def test_stream_of_upserts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "E", 1), ("b", "E", 2)], "node_id string, type string, x int").coalesce(1).write.parquet(src)
    db = Database(spark)
    stream = read_folder(spark, src, "node_id string, type string, x int", 1)
    upsert_nodes(stream, db, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("b", "E", 5), ("c", "E", 3)], "node_id string, type string, x int").coalesce(1).write.mode("append").parquet(src)
    upsert_nodes(stream, db, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.node_id, r.x) for r in db.node_table("E").collect()) == [("a", 1), ("b", 5), ("c", 3)]


def test_windows_in_a_stream_and_a_table(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:30:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    table = sorted((str(r.start), r.k, r.n, r.total) for r in windowed(df, "ts", "k", "v").collect())
    assert table == [("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 01:00:00", "b", 1, 4.0)]
    df.write.parquet(str(tmp_path / "ev"))
    stream = read_folder(spark, str(tmp_path / "ev"), "ts timestamp, k string, v double")
    q = windowed(stream, "ts", "k", "v").writeStream.format("memory").queryName("win").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start), r.k, r.n, r.total) for r in spark.table("win").collect()) == table
    assert sorted((r.k, r.n) for r in sessions(df, "ts", "k").collect()) == [("a", 2), ("b", 1)] or sessions(df, "ts", "k").count() == 3


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(i, c) for i, c in enumerate(["a", "b", "c", "d", "iso"])], "gid long, node_id string")
    edges = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 3), (4, 2, 3)], "eid long, src long, dst long")
    return PropertyGraph(spark, {"Entity": nodes}, {"REL": edges})


def test_mini_batches(g):
    index, ids = gnn_subgraph(g, [0], [2], ["REL"], strategy="first")
    assert index.tolist() == [[0, 0], [1, 2]]
    assert ids.tolist() == [0, 1, 2]
    index, ids = gnn_subgraph(g, [4], [2], ["REL"])
    assert (index.shape, ids.tolist()) == ((2, 0), [4])
    assert [n.tolist()[:2] for _, n in neighbor_loader(g, g.nodes("Entity"), [1], ["REL"], batch_size=2)][:2] == [[0, 1], [2, 3]]


def test_features(spark):
    view = FeatureView(spark.createDataFrame([(1, 0.5), (2, 0.7)], "gid long, f double"))
    assert view.lookup(1) == {"gid": 1, "f": 0.5}
    assert view.lookup(9) == {}
    assert view.lookup_many([2, 9]) == [{"gid": 2, "f": 0.7}, None]
    assert view.join(spark.createDataFrame([(1,), (3,)], "gid long")).orderBy("gid").collect() == [(1, 0.5), (3, None)]
    assert view.stats()["lookups"] == 2
    held = FeatureView(view.features).online()
    assert [held.lookup(k) for k in (1, 9, 2)] == [{"gid": 1, "f": 0.5}, {}, {"gid": 2, "f": 0.7}]
    assert held.lookup_many([2, 9]) == [{"gid": 2, "f": 0.7}, None]
    assert held.stats()["p99_ms"] < 5
    with pytest.raises(GraphError):
        FeatureView(view.features).online(most=1)


def test_batches_are_sampled_alone(g):
    edges = ["REL"]
    for batch, (index, n) in enumerate(neighbor_loader(g, g.nodes("Entity"), [1, 1], edges, batch_size=2, seed=5, prefetch=2)):
        alone = gnn_subgraph(g, n.tolist()[: 2 if batch < 2 else 1], [1, 1], edges, seed=5 + 2 * batch)
        assert (index.tolist(), n.tolist()) == (alone[0].tolist(), alone[1].tolist())


def test_observability(spark):
    db = Database(spark)
    db.insert_node_table([{"node_id": f"n{i}", "type": "E", "x": i} for i in range(20)])
    p = db.profile("MATCH (e:E) WHERE e.x > 4 RETURN e.x % 3 AS r, count(*) AS n")
    assert p["rows"] == 3
    assert any(o["operator"] == "HashAggregate" and o["rows"] == 3 for o in p["operators"])
    assert {"Aggregate", "Filter"} <= {o["operator"] for o in db.explain_logical("MATCH (e:E) WHERE e.x > 4 RETURN count(*) AS n")}
    assert [c.name for c in db.tracer.roots[0].children] == ["plan", "run"]
    assert "query" in db.tracer.roots[0].tree()


def test_user_functions(spark):
    r = UdfRegistry()

    @r.udf("double", ["double"])
    def twice(x):
        return pc.multiply(x, 2.0)

    r.expression("add", ["a", "b"], lambda a, b: a + b)
    df = spark.createDataFrame([(1,), (2,)], "x long")
    assert [t[0] for t in df.select(r["twice"](F.col("x")).alias("t")).collect()] == [2.0, 4.0]
    assert [t[0] for t in df.select(r["add"](F.col("x"), F.lit(1))).collect()] == [2, 3]
    for bad in (lambda: r["add"](F.lit(1)), lambda: r["nope"], lambda: r.expression("add", [], lambda: F.lit(1))):
        with pytest.raises(GraphError):
            bad()


def test_exports_and_shapes(spark, g, tmp_path):
    assert export.export_parquet(g, str(tmp_path / "p")) == ["nodes/Entity", "edges/REL"]
    assert spark.read.parquet(str(tmp_path / "p/edges/REL")).count() == 5
    export.export_arrow({"nodes/Entity": g.nodes("Entity")}, str(tmp_path / "x.arrow"))
    assert export.import_arrow(spark, str(tmp_path / "x.arrow"))["nodes/Entity"].count() == 5
    with pytest.raises(GraphError):
        export.export_arrow({}, str(tmp_path / "y.arrow"))
    shapes = [("a", "b", "c"), {"subject": 1, "predicate": 2, "object": 3}, {"start": 1, "end": 2}, {"src": 1, "dst": 2}, {"labels": ["X"], "id": 1}, {"@id": "http://x/1", "@type": "http://x/T"}, {"id": 1, "type": "T"}]
    assert [ingest.shape_of(s)[0] for s in shapes] == ["triple", "triple", "edge", "edge", "node", "node", "node"]
    with pytest.raises(GraphError):
        ingest.shape_of({"q": 1})


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *_: spark)
    path = str(tmp_path / "db")
    assert cli.main(["init", path]) == 0
    assert cli.main(["run", path, "CREATE CLASS A; INSERT A { x: 1 }"]) == 0
    assert cli.main(["run", path, "MATCH (a:A) RETURN a.x"]) == 0
    assert "{'x': 1}" in capsys.readouterr().out
    assert cli.main(["explain", path, "MATCH (a:A) RETURN a.x"]) == 0
    assert cli.main(["profile", path, "MATCH (a:A) RETURN a.x"]) == 0
    assert "1 rows" in capsys.readouterr().out
    assert cli.main(["compact", path]) == 0
    assert cli.main(["pack", path, str(tmp_path / "z.zip")]) == 0
    assert cli.main(["unpack", str(tmp_path / "z.zip"), str(tmp_path / "copy")]) == 0
    assert cli.main(["diff", path, str(tmp_path / "copy")]) == 0
    assert cli.main(["run", path, "MATCH (a:Nope) RETURN a"]) == 2
