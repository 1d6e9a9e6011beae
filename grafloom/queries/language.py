"""Queries in the query language over the sales graph and the graph store, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grafloom.lang.compiler import compile_query
from grafloom.queries.world import STORE_SQL, chain_graph, overlapping_graph, sales_graph, store_graph

#: name: (graph, text, SQL)
_ALL = {
    "match_filter_project": (sales_graph, "MATCH (c:Customer) WHERE c.c_acctbal > 5000 AND c.c_mktsegment = 'BUILDING' RETURN c.node_id, c.c_name AS name, c.c_acctbal", "select 'customer/' || c_custkey node_id, c_name as name, c_acctbal from customer where c_acctbal > 5000 and c_mktsegment = 'BUILDING'"),
    "match_prop_map": (sales_graph, "MATCH (p:Part {p_size: 15}) RETURN p.p_partkey, p.p_brand", "select p_partkey, p_brand from part where p_size = 15"),
    "order_skip_limit": (sales_graph, "MATCH (o:Order) RETURN o.o_orderkey, o.o_totalprice ORDER BY o.o_totalprice DESC, o.o_orderkey SKIP 5 LIMIT 20", "select o_orderkey, o_totalprice from orders order by 2 desc, 1 limit 20 offset 5"),
    "return_distinct": (sales_graph, "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS segment, c.c_nationkey AS nation", "select distinct c_mktsegment segment, c_nationkey nation from customer"),
    "is_null_in_case": (store_graph, "MATCH (n:Entity) WHERE n.entity_type IS NOT NULL OR n.gid IN [5, 6, 7] RETURN n.gid, CASE WHEN n.entity_type IN ['method', 'person'] THEN 'a' WHEN n.entity_type IS NULL THEN 'none' ELSE 'b' END AS kind",
        f"with {STORE_SQL} select gid, case when entity_type in ('method', 'person') then 'a' when entity_type is null then 'none' else 'b' end kind from nodes where node_type = 'Entity' and (entity_type is not null or gid in (5, 6, 7))"),
    "one_hop": (sales_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 RETURN c.c_name, o.o_orderkey", "select c_name, o_orderkey from customer join orders on o_custkey = c_custkey where o_totalprice > 200000"),
    "two_hop_edge_properties": (sales_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity >= 49 AND p.p_size < 10 RETURN c.c_custkey, o.o_orderkey, p.p_partkey, l.l_quantity AS quantity, l.eid AS line",
        "select c_custkey, o_orderkey, p_partkey, l_quantity quantity, l_orderkey * 10 + l_linenumber line from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_quantity >= 49 and p_size < 10"),
    "three_hop_where": (sales_graph, "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' AND o.o_orderstatus = 'F' RETURN n.n_name AS nation, count(*) AS orders, sum(o.o_totalprice) > 0 AS positive",
        "select n_name nation, count(*) orders, sum(o_totalprice) > 0 positive from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' and o_orderstatus = 'F' group by 1"),
    "reverse_hop": (sales_graph, "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name, s.s_name", "select n_name, s_name from nation join supplier on s_nationkey = n_nationkey"),
    "both_directions": (store_graph, "MATCH (a:Gene)-[r:interactsWith]-(b:Gene) RETURN a.gid AS a, b.gid AS b, r.eid AS eid",
        f"with {STORE_SQL}, g as (select gid from nodes where node_type = 'Gene'), s as (select src a, dst b, eid from edges where edge_type = 'interactsWith' union all select dst, src, eid from edges where edge_type = 'interactsWith') select a, b, eid from s where a in (select gid from g) and b in (select gid from g)"),
    "relation_union": (store_graph, "MATCH (a:Entity)-[r:RELATED_TO|EVIDENCED_BY]->(b) WHERE a.entity_type = 'person' RETURN a.gid AS a, type(r) AS relation, count(*) AS n, count(DISTINCT b.gid) AS ends",
        f"with {STORE_SQL} select a.gid a, edge_type relation, count(*) n, count(distinct b.gid) ends from edges join nodes a on a.gid = src join nodes b on b.gid = dst where edge_type in ('RELATED_TO', 'EVIDENCED_BY') and a.node_type = 'Entity' and a.entity_type = 'person' group by 1, 2"),
    "optional_match": (sales_graph, "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 250000 RETURN c.c_custkey, o.o_orderkey", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 250000"),
    "shared_alias": (sales_graph, "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) WHERE s.s_acctbal > 9000 RETURN n.n_name, count(DISTINCT c.gid) AS customers, count(DISTINCT s.gid) AS suppliers",
        "select n_name, count(distinct c_custkey) customers, count(distinct s_suppkey) suppliers from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey where s_acctbal > 9000 group by 1"),
    "with_aggregate_filter": (sales_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n, max(o.o_totalprice) AS top WHERE n >= 15 RETURN c.c_name, n, top", "select c_name, count(*) n, max(o_totalprice) top from customer join orders on o_custkey = c_custkey group by c_custkey, c_name having count(*) >= 15"),
    "unwind_list": (sales_graph, "MATCH (r:Region) UNWIND [1, 2, 3] AS x RETURN r.r_name, x * 10 AS ten", "select r_name, x * 10 ten from region, (values (1), (2), (3)) t(x)"),
    "var_length_match": (sales_graph, "MATCH p = (c:Customer)-[:IN_NATION|IN_REGION*1..2]->(x) RETURN c.c_custkey, length(p) AS hops, x.node_id AS place",
        "select c_custkey, 1 hops, 'nation/' || c_nationkey place from customer union all select c_custkey, 2, 'region/' || n_regionkey from customer join nation on n_nationkey = c_nationkey"),
    "var_length_store": (store_graph, "MATCH p = (a:Account {gid: 9})-[:transferredTo*2..2]->(b:Account) RETURN a.gid AS a, b.gid AS b, length(p) AS hops, relationships(p) AS eids",
        f"with {STORE_SQL}, t as (select eid, src, dst from edges where edge_type = 'transferredTo') select x.src a, y.dst b, 2 hops, [x.eid, y.eid] eids from t x join t y on x.dst = y.src join nodes s on s.gid = x.src and s.node_type = 'Account' join nodes n on n.gid = y.dst and n.node_type = 'Account' where x.src = 9 and y.dst <> 9 and x.dst <> 9 and x.dst <> y.dst"),
    "subclassof": (sales_graph, "MATCH (a:Agent) WHERE a.class SUBCLASSOF* Agent AND a.gid > 0 RETURN a.node_id, a.class_iri", "select 'customer/' || c_custkey node_id, 'local:Customer' class_iri from customer union all select 'supplier/' || s_suppkey, 'local:Supplier' from supplier"),
    "degree_function": (store_graph, 'MATCH (e:Entity) WHERE degree(e, "RELATED_TO") > 2 RETURN e.gid, degree(e, "RELATED_TO") AS mentions',
        f"with {STORE_SQL} select gid, count(*) mentions from nodes join edges on src = gid where node_type = 'Entity' and edge_type = 'RELATED_TO' group by gid having count(*) > 2"),
    "exists_pattern": (sales_graph, "MATCH (s:Supplier) WHERE EXISTS (s)-[:IN_NATION]->(n:Nation {n_name: 'CHINA'}) OR s.s_acctbal > 9000 RETURN s.s_name", "select s_name from supplier where s_nationkey in (select n_nationkey from nation where n_name = 'CHINA') or s_acctbal > 9000"),
    "scalar_functions": (sales_graph, "MATCH (p:Part) RETURN p.p_partkey, abs(0 - p.p_size) AS a, round(p.p_retailprice / 10) AS r, ceil(p.p_retailprice) AS c, floor(p.p_retailprice) AS f, length(p.p_name) AS n, upper(p.p_type) AS u, lower(p.p_brand) AS l, starts_with(p.p_name, 'a') AS s, ends_with(p.p_type, 'L') AS e, contains(p.p_type, 'B') AS b, coalesce(p.p_brand, 'x') AS co, p.p_size % 7 AS m, p.p_size :: STRING AS t",
        "select p_partkey, abs(0 - p_size) a, round_even(p_retailprice / 10, 0) r, ceil(p_retailprice) c, floor(p_retailprice) f, length(p_name) :: int n, upper(p_type) u, lower(p_brand) l, starts_with(p_name, 'a') s, ends_with(p_type, 'L') e, contains(p_type, 'B') b, coalesce(p_brand, 'x') co, p_size % 7 m, p_size :: varchar t from part"),
    "date_functions": (sales_graph, "MATCH (o:Order) WHERE o.o_orderdate >= DATETIME '1995-03-01 00:00:00' RETURN year(o.o_orderdate) AS y, month(o.o_orderdate) AS m, day(o.o_orderdate) AS d, count(*) AS n", "select year(o_orderdate) :: int y, month(o_orderdate) :: int m, day(o_orderdate) :: int d, count(*) n from orders where o_orderdate >= timestamp '1995-03-01' group by 1, 2, 3"),
    "list_functions": (store_graph, "MATCH (e:Entity) RETURN e.gid, size(e.aliases) AS n, head(e.aliases) AS first, last(e.aliases) AS final, sort(e.aliases) AS sorted, e.aliases[1] AS second",
        f"with {STORE_SQL} select gid, len(aliases) :: int n, aliases[1] as first, aliases[-1] final, list_sort(aliases) sorted, aliases[2] as second from nodes where node_type = 'Entity'"),
    "aggregate_functions": (sales_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS segment, count(*) AS n, min(o.o_totalprice) AS low, max(o.o_totalprice) AS high, count(DISTINCT o.o_orderstatus) AS states", "select c_mktsegment segment, count(*) n, min(o_totalprice) low, max(o_totalprice) high, count(distinct o_orderstatus) states from customer join orders on o_custkey = c_custkey group by 1"),
    "distinct_aggregates": (sales_graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_nationkey AS nation, round(avg(DISTINCT c.c_acctbal) * 1000) AS a, sum(DISTINCT o.o_orderkey) AS s, count(DISTINCT o.o_custkey) AS n, max(DISTINCT o.o_orderkey) AS m, size(collect(DISTINCT c.c_mktsegment)) AS segments",
        "select c_nationkey nation, round_even(avg(distinct c_acctbal) * 1000, 0) a, sum(distinct o_orderkey) :: bigint s, count(distinct o_custkey) n, max(o_orderkey) m, count(distinct c_mktsegment) :: int segments from customer join orders on o_custkey = c_custkey group by 1"),
    "spread_aggregates": (sales_graph, "MATCH (c:Customer) RETURN c.c_mktsegment AS segment, round(stddev(c.c_acctbal) * 1000) AS sd, percentile(c.c_nationkey, 0.25) AS low",
        "select c_mktsegment segment, round_even(stddev_samp(c_acctbal) * 1000, 0) sd, quantile_cont(c_nationkey, 0.25) :: double low from customer group by 1"),
    "xor_and_casts": (sales_graph, "MATCH (p:Part) WHERE p.p_size > 25 XOR p.p_retailprice > 1400 RETURN p.p_partkey, p.p_retailprice::INT AS whole, p.p_size::STRING AS size, p.p_name::INT64 AS none",
        "select p_partkey, trunc(p_retailprice) :: bigint whole, p_size :: varchar size, null :: bigint as none from part where (p_size > 25) <> (p_retailprice > 1400)"),
    "unlabelled_properties": (store_graph, "MATCH (a:Chunk)-[:MENTIONS]->(b) WHERE b.entity_type = 'person' RETURN b.node_type AS type, b.canonical_name AS name, count(*) AS n",
        f"with {STORE_SQL} select b.node_type as type, b.canonical_name as name, count(*) n from edges join nodes a on a.gid = src join nodes b on b.gid = dst where edge_type = 'MENTIONS' and a.node_type = 'Chunk' and b.entity_type = 'person' group by 1, 2"),
    "union_queries": (sales_graph, "MATCH (c:Customer) RETURN c.c_nationkey AS nation UNION MATCH (s:Supplier) WHERE s.s_acctbal > 5000 RETURN s.s_nationkey AS nation", "select c_nationkey nation from customer union select s_nationkey from supplier where s_acctbal > 5000"),
    "except_queries": (sales_graph, "MATCH (c:Customer) RETURN c.c_custkey AS key EXCEPT MATCH (s:Supplier) RETURN s.s_suppkey AS key", "select c_custkey as key from customer except select s_suppkey from supplier"),
    "label_conjunction": (overlapping_graph, "MATCH (c:Builder&Rich) RETURN c.c_custkey, c.c_name", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_acctbal > 5000"),
    "no_upper_bound": (chain_graph, "MATCH p = (a:Nation)-[:NEXT*]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(p) AS hops",
        "with n as (select n_nationkey k, row_number() over (order by n_nationkey) :: int i from nation) select a.k a, b.k b, b.i - a.i hops from n a join n b on b.i > a.i"),
    "sixteen_hops_or_more": (chain_graph, "MATCH p = (a:Nation)-[:NEXT*16..]->(b) RETURN a.n_nationkey AS a, length(p) AS hops, relationships(p) AS eids",
        "with n as (select n_nationkey k, row_number() over (order by n_nationkey) :: int i from nation) select a.k a, b.i - a.i hops, range(a.i :: bigint, b.i :: bigint) eids from n a join n b on b.i >= a.i + 16"),
}


def _query(make: Callable, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: compile_query(make(spark, sf), text)


def as_of_query(spark: SparkSession, sf: str) -> DataFrame:
    g = store_graph(spark, sf)
    g.create_snapshot("v1", 40_000)
    return compile_query(g, "MATCH (a:Entity)-[r:RELATED_TO]->(b:Entity) AS_OF SNAPSHOT 'v1' RETURN a.gid AS a, b.gid AS b, r.eid AS eid")


QUERIES = {name: _query(make, text) for name, (make, text, _) in _ALL.items()} | {"as_of_query": as_of_query}
_VISIBLE = "_created_lsn <= 40000 and (_deleted_lsn is null or _deleted_lsn > 40000)"
SQL = {name: sql for name, (_, _, sql) in _ALL.items()} | {
    "as_of_query": f"""with n as (select distinct nid from node_store where node_type = 'Entity' and {_VISIBLE}), e as (select distinct eid, src, dst from edge_store where edge_type = 'RELATED_TO' and {_VISIBLE})
        select src a, dst b, eid from e where src in (select nid from n) and dst in (select nid from n)"""
}
