import random

from pyspark.sql import functions as F

from grafloom.llm.mixing import _queue_end, mix_sources


def brute(spark, docs, targets, budget, seed):
    """The queue in plain Python, with Spark's hash of the ids as the shuffled order."""
    ids = spark.createDataFrame([(d[0],) for d in docs if d[0] is not None], "id long").distinct()
    turn = {r.id: r.h for r in ids.select("id", F.xxhash64(F.lit(seed), "id").alias("h")).collect()}
    queue = []
    for source, share, cap in targets:
        own = sorted((turn[i], i, n) for i, s, n in docs if s == source and i is not None and n)
        total, at = sum(n for _, _, n in own), 0
        for copy in range(1, cap + 1):
            at = (copy - 1) * total
            for _, i, n in own:
                at += n
                queue.append((at / share, source, copy, i, n))
    picks, served = set(), 0
    for finish, source, copy, i, n in sorted(queue):
        served += n
        if served > budget:
            break
        picks.add((i, source, copy, n, finish))
    return picks


def frames(spark, docs, targets):
    return (
        spark.createDataFrame([(*d, "x", 0.5) for d in docs], "id long, source string, size long, copy string, finish double"),
        spark.createDataFrame([(*t, 1) for t in targets], "source string, share double, cap int, size int"),
    )


def test_against_brute_force(spark):
    r = random.Random(5)
    docs = [(i, r.choice(["a", "a", "a", "b", "b", "c", None, "other"]), r.choice([None, 0, 1, 7, 30, 200])) for i in range(400)]
    docs += [(1000, "tiny", 9), (None, "a", 5)]
    targets = [("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.1, 4), ("tiny", 0.1, 6), ("gone", 0.1, 3)]
    for budget in (0, 1, 500, 5_000, 20_000, 10**6):
        picks, report = mix_sources(*frames(spark, docs, targets), budget=budget, seed=7)
        want = brute(spark, docs, targets, budget, 7)
        assert {tuple(x) for x in picks.collect()} == want
        got = {x.source: x for x in report.collect()}
        assert set(got) == {t[0] for t in targets}
        total = sum(n for *_, n, _ in want)
        for source, share, cap in targets:
            mine = [w for w in want if w[1] == source]
            x = got[source]
            assert (x.size, x.picks, x.target_share) == (sum(w[3] for w in mine), len(mine), share)
            assert x.copies <= cap
            assert abs(x.actual_share - (x.size / total if total else 0)) < 1e-12
            if total and mine and x.state not in ("exhausted", "no documents"):
                off = x.size - share * total
                assert x.state == ("met" if abs(off) <= max(0.01 * share * total, max(n or 0 for _, s, n in docs if s == source)) else "over" if off > 0 else "under")
        assert got["gone"].state == "no documents"


def test_shares_are_kept_while_documents_last(spark):
    docs = [(i, "a" if i % 3 else "b", 10) for i in range(9000)]
    _, report = mix_sources(*frames(spark, docs, [("a", 0.7, 1), ("b", 0.3, 1)]), budget=40_000)
    got = {x.source: x for x in report.collect()}
    assert abs(got["a"].actual_share - 0.7) < 0.001
    assert {x.state for x in got.values()} == {"met"}


def test_empty(spark):
    picks, report = mix_sources(*frames(spark, [], [("a", 1.0, 2)]))
    assert picks.collect() == []
    assert [(x.source, x.size, x.state) for x in report.collect()] == [("a", 0, "no documents")]


def test_queue_end_is_late_enough():
    assert _queue_end([(0.5, 100, 10), (0.5, 1000, 10)], 10_000) is None
    end = _queue_end([(0.5, 100, 10), (0.5, 1000, 10)], 500)
    assert min(0.5 * end, 100) + min(0.5 * end, 1000) >= 500 + 20
