"""Closures of a hierarchy as tables, and rules that add edges until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.catalog import Catalog
from grafloom.errors import GraphError
from grafloom.graph import PropertyGraph
from grafloom.plans.runtime import cut


def closure_table(g: PropertyGraph) -> DataFrame:
    """`ancestor`, `descendant`: every pair of the class hierarchy, a class with itself too."""
    c: Catalog = g.catalog
    rows = [(a, n) for n in c.classes for a in c.ancestors(n)]
    return g.spark.createDataFrame(rows, "ancestor string, descendant string")


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """The reverse edges (`src`, `dst`) that are not there yet, each once."""
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(e, ["src", "dst"], "left_anti")


def transitive_edges(edges: DataFrame, max_iterations: int = 16, budget: int | None = None) -> tuple[DataFrame, int]:
    """The edges (`src`, `dst`) that transitivity adds, self-pairs too, and the number of rounds.

    Semi-naive and doubling: each round joins only the pairs that the last one found with all pairs known so far, and
    keeps the new ones, so r rounds reach 2^r steps. A round that still finds pairs after `max_iterations` is an error,
    as are more than `budget` new pairs; what is returned is always whole.
    """
    base = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    known, new, total, rounds = base, base, 0, 0
    while True:
        rounds += 1
        step = new.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).distinct()
        new = cut(step.join(known, ["src", "dst"], "left_anti"))
        n = new.count()
        if not n:
            break
        if rounds > max_iterations:
            raise GraphError(6012, f"not closed after {max_iterations} rounds")
        total += n
        if budget is not None and total > budget:
            raise GraphError(6012, f"more than {budget} inferred edges")
        known = cut(known.unionByName(new))
    return known.join(base, ["src", "dst"], "left_anti"), rounds


def infer_closure(g: PropertyGraph, names: list[str], max_iterations: int = 16, budget: int | None = None) -> tuple[PropertyGraph, dict[str, dict]]:
    """The graph with the edges that the characteristics of the properties `names` add (`_inferred` is true there)."""
    edges, report = dict(g.stored_edges), {}
    for name in names:
        kinds = g.catalog.properties[name].characteristics if name in g.catalog.properties else []
        added, rounds, have = 0, 0, g.edges(name)
        for kind in ("SYMMETRIC", "TRANSITIVE"):
            if kind not in kinds:
                continue
            new, n = (symmetric_edges(have), 1) if kind == "SYMMETRIC" else transitive_edges(have, max_iterations, budget)
            top = have.agg(F.max("eid")).first()[0] or 0
            # Ids follow the order of the pairs; one row per partition of the sorted pairs is numbered on its own.
            new = cut(new.withColumn("eid", F.lit(top + 1) + F.monotonically_increasing_id()).withColumn("_inferred", F.lit(True)))
            added, rounds = added + new.count(), rounds + n
            have = have.unionByName(new, allowMissingColumns=True)
        edges[name] = have
        report[name] = {"added": added, "iterations": rounds}
    return PropertyGraph(g.spark, g.stored_nodes, edges, g.catalog, g.lsn, g.snapshots), report
