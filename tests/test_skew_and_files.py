import random
import zlib

import pytest
from pyspark.sql import functions as F

from grafloom.functions.prefix import running_before
from grafloom.operators import compaction, skew


def test_salted_aggregate(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1, 1, 1, None, r.randint(0, 50)]), r.choice([None, float("nan"), 0.5, 2.0])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k long, w double").repartition(7)
    hot = skew.heavy_keys(df, "k", 10)
    assert hot == [1]
    got = skew.salted_aggregate(df, ["k"], F.col("k").isin(hot), F.col("id"), 8, {"n": F.count("*"), "s": F.sum(F.when(~F.isnan("w"), F.col("w")))}, {"n": F.sum("n"), "s": F.sum("s")})
    want = {}
    for _, k, w in rows:
        n, s = want.get(k, (0, None))
        want[k] = (n + 1, s if w is None or w != w else (s or 0) + w)
    assert {x.k: (x.n, x.s) for x in got.collect()} == want
    assert skew.heavy_keys(df.limit(0), "k") == []
    assert skew.one_per_id(spark.createDataFrame([(1, None), (1, 5), (None, 3)], "id long, x long"), "id", ["x"]).collect() == [(1, 5)]


def test_running_before(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, r.randint(-5, 5)])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    got = running_before(df, ["g"], F.floor(F.col("i") / 16), [F.col("i")], {"s": ("sum", "v"), "m": ("max", "v")})
    for x in got.collect():
        before = [v for g, i, v in rows if g == x.g and i < x.i and v is not None]
        assert (x.s, x.m) == ((sum(before), max(before)) if before else (None, None))
    assert len(got.columns) == 5


def plan_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "chunk_id long, local_name string, path string, row_count long, a long, b long, n_bytes long, store string")
    refs = compaction.resolved(compaction.references(df, "node", "nodes", "a", "b"))
    plan = compaction.container_plan(refs, **more)
    index = compaction.container_index(refs, **more)
    assert index.exceptAll(plan.where("state = 'copied'").drop("state")).isEmpty()
    assert {r.chunk_id for r in compaction.held_elsewhere(refs, index).collect()} == {r.chunk_id for r in plan.where("state = 'covered'").collect()}
    return plan


def test_plan_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        a = r.randint(0, 400)
        rows.append((i, r.choice("XYY"), f"c/{i}", 1, a, a + r.choice([0, 1, 2, 5, 5, 30]), r.choice([None, 0, 3, 10]), "q"))
    rows += [(1000 + i, n, p, c, a, b, s, q) for i, (_, n, p, c, a, b, s, q) in enumerate(rows[:60])]
    for block in (7, 10_000):
        got = {x.chunk_id: x for x in plan_of(spark, rows, target_bytes=40, block=block).collect()}
        assert len(got) == len(rows)
        for cid, store, _, _, a, b, _, _ in rows:
            covers = any(s == store and c != cid and x <= a and b <= y and (y - x > b - a or c < cid) for c, s, _, _, x, y, _, _ in rows)
            want = "empty" if a >= b else "covered" if covers else "copied"
            assert got[cid].state == want, (cid, a, b)
        for store in "XY":
            listed = {i for _, s, _, _, a, b, _, _ in rows if s == store for i in range(a, b)}
            taken = [i for x in got.values() if x.store == store and x.state == "copied" for i in range(x.take_start, x.take_stop)]
            assert sorted(taken) == sorted(listed)
            boxes = {}
            for x in sorted((x for x in got.values() if x.store == store and x.state == "copied"), key=lambda x: (x.container, x.take_start)):
                assert x.offset == boxes.get(x.container, 0)
                boxes[x.container] = x.offset + x.length


def test_paths_of_one_file(spark):
    spellings = ["c/1.col", "./c/1.col", "c//1.col", "c\\1.col", "c/../c/1.col", "nodes/X/c/1.col", "/nodes/X/c/1.col", "../X/c/1.col", "../../nodes/X/c/1.col", "data/nodes/X/./c/1.col"]
    rows = [(i, "X", p, 1, 10 if i == 0 else None, 20 if i == 0 else None, 1, "q") for i, p in enumerate(spellings)]
    rows += [(90, "X", "c/2.col", 1, None, None, 1, "q"), (91, "Y", "c/1.col", 1, None, 5, 1, "q"), (92, "X", None, 1, None, None, 1, "q")]
    got = {x.chunk_id: (x.state, x.file) for x in plan_of(spark, rows).collect()}
    assert got[0] == ("copied", "c/1.col")
    assert {got[i] for i in range(1, len(spellings))} == {("covered", "c/1.col")}
    assert got[90][0] == got[91][0] == got[92][0] == "unknown"
    assert plan_of(spark, []).collect() == []


def test_archive_round_trip(spark, tmp_path):
    r = random.Random(4)
    files = [(f"d/{i}", r.randbytes(r.choice([0, 1, 50, 3000]))) for i in range(400)] + [("none", None), (None, b"x"), ("d/5", b"again")]
    df = spark.createDataFrame(files, "path string, content binary").repartition(6)
    folder = str(tmp_path / "arc")
    index = compaction.pack_files(df, folder, target_bytes=20_000, blocks=8)
    rows = index.collect()
    assert sorted((x.path, x.length, x.crc32) for x in rows) == sorted((p, len(c or b""), zlib.crc32(c or b"")) for p, c in files if p)
    names = {p.name for p in (tmp_path / "arc").iterdir() if p.suffix == ".bin" and not p.name.startswith(".")}
    assert names == {x.container for x in rows}
    assert 10 < len(names) < 40
    back = sorted((x.path, bytes(x.content)) for x in compaction.read_packed(index, folder).collect())
    assert back == sorted((p, c or b"") for p, c in files if p)
    assert [bytes(x.content) for x in compaction.read_packed(index.where("path = 'd/7'"), folder).collect()] == [files[7][1]]
    victim = max(rows, key=lambda x: x.length)
    data = bytearray((tmp_path / "arc" / victim.container).read_bytes())
    data[victim.offset] ^= 255
    (tmp_path / "arc" / victim.container).write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        compaction.read_packed(index, folder).collect()
    assert compaction.pack_files(df.limit(0), str(tmp_path / "none")).collect() == []
