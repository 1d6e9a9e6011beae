"""Queries that load a database, change it and look at the result, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.database import Database
from grafloom.plans.runtime import table


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """New balances merged into the customers by key: given values win, the rest stays, new keys are added."""
    db = Database(spark)
    key = F.col("c_custkey").cast("string").alias("node_id")
    db.insert_node_table(table(spark, sf, "customer").select(key, F.lit("Customer").alias("type"), F.col("c_custkey").cast("bigint"), "c_name", "c_acctbal"))
    old = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    new = table(spark, sf, "node_store").where("balance is not null and not isnan(balance)").groupBy((F.col("nid") + 1_000_000).alias("c_custkey")).agg(F.max("balance").alias("c_acctbal"))
    db.upsert_node_table(old.unionByName(new).select(key, F.lit("Customer").alias("type"), "c_custkey", "c_acctbal"))
    return db.node_table("Customer", ["c_custkey", "c_name", "c_acctbal"])


def _nations(spark: SparkSession, sf: str) -> Database:
    db = Database(spark)
    n = table(spark, sf, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("node_id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("key"))
    r = table(spark, sf, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit("Region").alias("type"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("key"))
    db.insert_node_table(n.unionByName(r))
    return db


def _in_region(spark: SparkSession, sf: str, weight: F.Column) -> DataFrame:
    return table(spark, sf, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("inRegion").alias("type"), weight.cast("double").alias("weight"))


def upsert_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges merged twice; in the second batch each comes twice, and the later row counts."""
    db = _nations(spark, sf)
    db.upsert_edge_table(_in_region(spark, sf, F.col("n_nationkey")))
    again = _in_region(spark, sf, F.col("n_nationkey") + 100).unionByName(_in_region(spark, sf, F.col("n_nationkey") + 200)).where("weight % 2 = 0")
    db.upsert_edge_table(again)
    return db.sql("MATCH (n:Nation)-[r:inRegion]->(g:Region) RETURN n.node_id AS nation, g.name AS region, r.weight AS weight").df


def triples_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Nations and their regions as triples: classes, two literals of one property, of which the later counts, and edges;
    the regions are only referred to."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("subject"), "n_name", "n_regionkey")
    row = lambda p, o: n.select("subject", F.lit(p).alias("predicate"), o.alias("object"))
    db = Database(spark)
    db.insert_triples(row("rdf:type", F.lit("Country")).unionByName(row("name", F.lit("?"))).unionByName(row("name", F.col("n_name"))).unionByName(row("inRegion", F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")))))
    return db.sql("MATCH (n:Country)-[:inRegion]->(r:Region) RETURN n.node_id AS nation, n.name AS name, r.node_id AS region").df


def update_statement(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes changed by a statement, some deleted with their edges, inside a transaction; and one that is undone."""
    db = _nations(spark, sf)
    db.upsert_edge_table(_in_region(spark, sf, F.col("n_nationkey")))
    db.execute("BEGIN; MATCH (n:Nation)-[:inRegion]->(r:Region) WHERE n.key < 20 SET n.key = n.key * 10 + r.key; MATCH (r:Region) WHERE r.name = 'ASIA' DETACH DELETE r; COMMIT")
    db.execute("BEGIN; MATCH (n:Nation) DETACH DELETE n; ROLLBACK")
    return db.sql("MATCH (n:Nation) OPTIONAL MATCH (n)-[:inRegion]->(r:Region) RETURN n.name AS name, n.key AS key, r.name AS region").df


def infer_knows(spark: SparkSession, sf: str) -> DataFrame:
    """A symmetric and transitive property closed over the nations of a region: all pairs, with themselves."""
    db = _nations(spark, sf)
    db.catalog.define_property("sameRegion", characteristics=["SYMMETRIC", "TRANSITIVE"])
    first = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    pairs = table(spark, sf, "nation").join(first, "n_regionkey").where("n_nationkey <> first")
    name = lambda c: F.concat(F.lit("nation/"), F.col(c).cast("string"))
    db.insert_edge_table(pairs.select(name("n_nationkey").alias("src"), name("first").alias("dst"), F.lit("sameRegion").alias("type")))
    db.infer_closure(["sameRegion"])
    return db.sql("MATCH (a:Nation)-[:sameRegion]->(b:Nation) RETURN DISTINCT a.key AS a, b.key AS b").df


def call_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the embeddings as nodes, searched by a statement; what it yields goes on in the query."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("v/"), F.col("vec_id").cast("string")).alias("node_id"), F.lit("Vector").alias("type"), "embedding", "label")
    db = Database(spark)
    db.insert_node_table(e)
    db.create_vector_index("by_embedding", "Vector", "embedding", len(e.first()["embedding"]), "l2")
    q = [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 7").first()["embedding"]]
    df = db.sql("CALL vector.search('by_embedding', $q, 10) YIELD node_id, score, rank RETURN node_id, score, rank", {"q": q}).df
    return df.withColumn("score", F.round("score", 6))


def text_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The names of parts through a stored token table, of which only the query's tokens are read."""
    db = Database(spark)
    part = table(spark, sf, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("Part").alias("type"), F.col("p_name").alias("kind"), F.col("p_partkey").cast("bigint").alias("key"))
    db.insert_node_table(part)
    db.create_text_index("kinds", "Part", ["kind"])
    hits = db.text_hits("kinds", "Red  ANVIL!")
    return hits.join(db.node_table("Part", ["gid", "key"]), "gid").select("key", "text")


def property_index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    db = Database(spark)
    db.insert_node_table(table(spark, sf, "customer").select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("Customer").alias("type"), F.col("c_nationkey").cast("bigint").alias("nation"), "c_name"))
    db.create_property_index("nations", "Customer", "nation")
    return db.property_lookup("nations", 7).select("node_id", "c_name")


def import_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Resources in three shapes; with the policy `skip` known ones stay as they are."""
    db = Database(spark)
    rows = [r.asDict() for r in table(spark, sf, "region").collect()]  # five rows
    db.import_resources([{"id": f"r/{r['r_regionkey']}", "type": "Region", "name": r["r_name"]} for r in rows])
    db.import_resources([{"labels": ["Region"], "id": f"r/{r['r_regionkey'] + 3}", "properties": {"name": "new"}} for r in rows], "skip")
    db.import_resources([{"src": f"r/{r['r_regionkey']}", "dst": f"r/{r['r_regionkey'] + 1}", "type": "next"} for r in rows])
    return db.sql("MATCH (a:Region)-[:next]->(b:Region) RETURN a.name AS a, b.name AS b").df


QUERIES = {f.__name__: f for f in (upsert_merge, upsert_edges, triples_insert, update_statement, infer_knows, call_vector_search, text_index_search, property_index_lookup, import_policies)}

SQL = {
    "upsert_merge": """with n as (select s_suppkey k, s_acctbal b from supplier union all select nid + 1000000, max(balance) from node_store where balance is not null and not isnan(balance) group by 1)
        select coalesce(c_custkey, k) c_custkey, c_name, coalesce(b, c_acctbal) c_acctbal from customer full join n on k = c_custkey""",
    "upsert_edges": "select 'nation/' || n_nationkey nation, r_name region, (n_nationkey + case when n_nationkey % 2 = 0 then 200 else 0 end) :: double weight from nation join region on r_regionkey = n_regionkey",
    "triples_insert": "select 'nation/' || n_nationkey nation, n_name as name, 'region/' || n_regionkey region from nation",
    "update_statement": "select n_name as name, case when n_nationkey < 20 then n_nationkey * 10 + n_regionkey else n_nationkey end :: bigint as key, case when r_name <> 'ASIA' then r_name end region from nation join region on r_regionkey = n_regionkey",
    "infer_knows": "select a.n_nationkey :: bigint a, b.n_nationkey :: bigint b from nation a join nation b on a.n_regionkey = b.n_regionkey where (select count(*) from nation c where c.n_regionkey = a.n_regionkey) > 1",
    "call_vector_search": """select 'v/' || vec_id node_id, round(-d, 6) score, row_number() over (order by d, vec_id) :: int as "rank" from
        (select vec_id, list_distance(embedding :: double[], (select embedding from embeddings where vec_id = 7) :: double[]) d from embeddings) order by d, vec_id limit 10""",
    "text_index_search": "select p_partkey :: bigint as key, p_name as text from part where len(list_intersect(string_split(lower(p_name), ' '), ['red', 'anvil'])) > 0",
    "property_index_lookup": "select 'c/' || c_custkey node_id, c_name from customer where c_nationkey = 7",
    "import_policies": "with r as (select r_regionkey k, r_name as name from region union all select r_regionkey + 3, 'new' from region where r_regionkey + 3 not in (select r_regionkey from region)) select a.name a, b.name b from region x join r a on a.k = x.r_regionkey join r b on b.k = x.r_regionkey + 1",
}
