import random
from collections import Counter

from pyspark.sql import functions as F

from grafloom.operators.references import asof_runs, key_runs, orphan_references, orphan_report

CHILD = "eid long, src long, dst long, at long, kind string, ingested timestamp, endpoint string, k long"
PARENT = "nid long, created long, deleted long, versions string, key string"


def brute(children, parents):
    out = Counter()
    for eid, src, dst, at, kind, *_ in children:
        for end, k in (("src", src), ("dst", dst)):
            if k is None:
                continue
            own = [(a, b) for n, a, b, *_ in parents if n == k and a is not None]
            if at is not None and any(a <= at and (b is None or at < b) for a, b in own):
                continue
            reason = "missing" if not own else "late" if at is not None and all(a > at for a, _ in own) else "deleted"
            out[eid, end, k, at, reason] += 1
    return out


def run(spark, children, parents, **more):
    c, p = spark.createDataFrame(children, CHILD), spark.createDataFrame(parents, PARENT)
    got = orphan_references(c, ["src", "dst"], "at", p, "nid", "created", "deleted", ["eid"], **more)
    return Counter(tuple(r) for r in got.collect())


def test_against_brute_force(spark):
    r = random.Random(4)
    parents = []
    for n in range(-40, 120):
        if r.random() < 0.8:
            at = r.choice([1, 1, 1, 5])
            for _ in range(r.choice([1, 1, 1, 2, 3])):
                end = None if r.random() < 0.7 else at + r.randint(1, 5)
                parents.append((n, at, end, "x", "y"))
                parents += [parents[-1]] * (r.random() < 0.2)
                if end is None:
                    break
                at = end + r.randint(0, 3)
    parents += [(None, 1, None, "x", "y"), (7, None, None, "x", "y")]
    children = [(i, r.choice([None, 3, 3, 3, r.randint(-60, 140)]), r.choice([None, r.randint(-60, 140)]), r.choice([None, *range(14)]), "K", None, "e", 1) for i in range(1500)]
    children += children[:50]
    want = brute(children, parents)
    assert run(spark, children, parents, bucket=16) == want
    assert run(spark, children, parents, hot_part=3) == want
    assert run(spark, children, []) == brute(children, [])
    assert run(spark, [], parents) == Counter()


def test_runs_share_a_history(spark):
    p = spark.createDataFrame([(n, 1, None) for n in (1, 2, 3, 5, 6)] + [(4, 1, 9), (7, 2, None)], "nid long, created long, deleted long")
    runs = key_runs(p, "nid", "created", "deleted", bucket=100)
    assert sorted((r.start, r.stop) for r in runs.collect()) == [(1, 3), (4, 4), (5, 6), (7, 7)]
    keys = spark.createDataFrame([(0,), (2,), (4,), (7,), (8,), (-5,)], "k long")
    got = {r.k: r.versions and [tuple(v) for v in r.versions] for r in asof_runs(keys, runs, 100).collect()}
    assert got == {0: None, 2: [(1, 2**63 - 1)], 4: [(1, 9)], 7: [(2, 2**63 - 1)], 8: None, -5: None}


def test_report_counts_records_once(spark):
    o = spark.createDataFrame([(1, "src", "missing", "2025-01-31", "A"), (1, "src", "missing", "2025-02-01", "A"), (2, "src", "late", "2025-02-01", "A")], "eid long, endpoint string, reason string, ts string, kind string")
    got = {tuple(r) for r in orphan_report(o.withColumn("ts", F.to_timestamp("ts")), "eid", "ts", ["kind"]).collect()}
    assert got == {("A", "src", "2025-01", "missing", 1), ("A", "src", "2025-02", "late", 1)}
