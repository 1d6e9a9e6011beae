"""Queries of the general data-processing problems: orphans, change feeds, heavy keys, small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.operators import changefeed, compaction, references, skew
from grafloom.plans.runtime import broadcast_if_small, scratch, table
from grafloom.sources import wal


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = table(spark, sf, "edge_store"), table(spark, sf, "node_store")
    return references.orphan_references(edges, ["src", "dst"], "_created_lsn", nodes, "nid", "_created_lsn", "_deleted_lsn", keep=["eid", "edge_type", "ingested_at"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("eid", "endpoint", "reason").distinct()


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, sf), "eid", "ingested_at", ["edge_type"])


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "wal_record")
    conflicts = broadcast_if_small(changefeed.conflicting(log, "bundle", "lsn", "prev_lsn"))
    valid = lambda rows: changefeed.valid_changes(rows, conflicts, "bundle", "lsn", "prev_lsn")
    commits = wal.commits(wal.parsed(log, [wal.COMMIT], nodes=False))
    return changefeed.committed_changes(valid(wal.node_changes(wal.parsed(log, list(wal.NODE_OPS)))), valid(commits), "bundle", "tx")


NODE = ["bundle", "class_name", "nid"]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The live nodes, with the column `lsn` by last writer wins."""
    return changefeed.live_rows(_changes(spark, sf), NODE, "lsn", "op", ["lsn"]).select(*NODE, "lsn")


def p3_state(spark: SparkSession, sf: str) -> DataFrame:
    changes = _changes(spark, sf).withColumn("props", F.expr(wal.fields_of("props")))
    return changefeed.last_writer_wins(changes, NODE, "lsn", "op", "props", "pos")


def p3_typed(spark: SparkSession, sf: str) -> DataFrame:
    """The state with values of their own types."""
    changes = _changes(spark, sf).withColumn("props", F.expr(wal.typed_fields_of("props")))
    return wal.typed(changefeed.last_writer_wins(changes, NODE, "lsn", "op", "props", "pos"), "value")


#: Salts of a heavy key, and the part of the edges (1 in so many) from which a key is heavy.
SALTS, HEAVY_PART = 64, 100


def p4_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per end and nid (null too): edges, and the sum of the weights that are numbers. Every eid counts once."""
    raw = table(spark, sf, "edge_store").select("eid", "src", "dst", "weight")
    hot = {e: skew.heavy_keys(raw, e, HEAVY_PART) for e in ("src", "dst")}
    ends = skew.one_per_id(raw, "eid", ["src", "dst", "weight"]).select(
        "eid", F.col("weight").cast("double").alias("w"), F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(e).alias("nid"), F.coalesce(F.col(e).isin(hot[e]), F.lit(False)).alias("hot")) for e in hot])).alias("x")
    )
    rows = ends.select("eid", "w", "x.*")
    partial = {"n": F.count("*"), "s": F.sum(F.when(~F.isnan("w"), F.col("w")))}
    return skew.salted_aggregate(rows, ["endpoint", "nid"], F.col("hot"), F.col("eid"), SALTS, partial, {"edges": F.sum("n"), "weight_sum": F.sum("s")})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    per = p4_totals(spark, sf)
    total = per.where("endpoint = 'src'").agg(F.sum("edges").alias("total"))  # each edge has one row at each end
    return per.crossJoin(F.broadcast(total)).where(f"nid is not null and edges * {HEAVY_PART} >= total").select("endpoint", "nid")


def _references(spark: SparkSession, sf: str) -> DataFrame:
    nodes = compaction.references(table(spark, sf, "node_chunk"), "node", "nodes", "start_nid", "end_nid")
    return compaction.resolved(nodes.unionByName(compaction.references(table(spark, sf, "edge_chunk"), "edge", "edges", "start_eid", "end_eid")))


def p5_plan(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.container_plan(_references(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """What the containers have no entry for, though it holds ids: they are held by other entries."""
    refs = _references(spark, sf)
    return compaction.held_elsewhere(refs, compaction.container_entries(refs)).select("store_kind", "chunk_id")


def p5_packed(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of all documents as files, packed into containers, looked up by the index and checked: of each file the
    length in the index and the digest of the bytes read back, which had the index's checksum."""
    d = table(spark, sf, "documents")
    files = d.select(F.concat_ws("/", F.lit("documents"), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    folder = scratch(spark, "packed")
    index = compaction.pack_files(files, folder, 1024 * 1024)
    back = compaction.read_packed(index, folder).select("path", F.md5("content").alias("digest"))
    return index.select("path", "length").join(back, "path")


def p5_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The files to write: per store and container the references in it, its bytes and ids."""
    return p5_plan(spark, sf).where("state = 'copied'").groupBy("store_kind", "store", "container").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sum(F.col("take_stop") - F.col("take_start")).alias("ids"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_state, p3_typed, p4_found, p4_totals, p5_found, p5_plan, p5_containers, p5_packed)}
