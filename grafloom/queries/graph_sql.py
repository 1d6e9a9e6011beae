"""DuckDB SQL that gives the rows of the queries in `graph`."""

from grafloom.queries.graph import ACCOUNTS, KNOWLEDGE, NAME, QUERY_VECTOR_ID, SEEDS
from grafloom.queries.world import BASE, PLACE, STORE_SQL

_W = f"with recursive {STORE_SQL}"
_K = ", ".join(f"'{k}'" for k in KNOWLEDGE)
_SEED_ROWS = ", ".join(f"({i}, {g})" for i, g in enumerate(SEEDS))


def _adj(types: str, direction: str, name: str = "adj") -> str:
    """Steps of relations `types` (SQL list) in `direction`."""
    sides = {"out": ["src, dst, 'out'"], "in": ["dst, src, 'in'"], "both": ["src, dst, 'out'", "dst, src, 'in'"]}[direction]
    return f", {name}(node, next, direction, edge_type, eid, src, dst, w) as (" + " union all ".join(f"select {s}, edge_type, eid, src, dst, coalesce(weight, 0.0) from edges where edge_type in ({types}) and src is not null and dst is not null" for s in sides) + ")"


def _top(n: int) -> str:
    return f", best as (select * from (select *, row_number() over (partition by node order by w desc, edge_type, eid, next) n from adj) where n <= {n})"


_LEVELS = """, walk as (
  select pos, gid :: bigint here, 0 depth, [{'w': 0.0 :: double, 't': '', 'e': pos :: bigint, 'n': gid :: bigint}] as key, null :: bigint via_edge_id, null :: varchar via_edge_type, 1.0 :: double prod from (values %s) s(pos, gid)
  union all
  select pos, a.next, depth + 1, list_append(key, {'w': %s :: double, 't': a.edge_type, 'e': a.eid, 'n': a.next}), a.eid, a.edge_type, prod * a.w from walk join %s a on a.node = walk.here where depth < %d),
low as (select here, min(depth) depth from walk group by here),
least as (select here, depth, min(key) as key from walk join low using (here, depth) group by here, depth),
found as (select distinct on (w.here) w.* from walk w join least using (here, depth, key))"""


def _paths(seeds: str, adj: str, depth: int, stop: str = "") -> str:
    return f""", walk as (
      select gid :: bigint seed, gid :: bigint here, 0 depth, [gid :: bigint] nodes, [] :: bigint[] eids, 1.0 :: double prod, 0.0 :: double total from (values {seeds}) s(pos, gid)
      union all
      select seed, a.next, depth + 1, list_append(nodes, a.next), list_append(eids, a.eid), prod * a.w, total + a.w from walk join {adj} a on a.node = walk.here
      where depth < {depth} and not list_contains(nodes, a.next) {stop})"""


_ENTRIES = """, raw as (select gid, 'canonical_name' as property, 0 pos, canonical_name as text from nodes where node_type = 'Entity' union all select gid, 'aliases', 1, unnest(aliases) from nodes where node_type = 'Entity'),
entries as (select *, trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g')) norm from raw where text is not null),
texts as (select *, list_distinct(string_split(norm, ' ')) tokens from entries where norm <> '')"""
_HITS = f"""{_ENTRIES}, hit as (select *, len(list_intersect(tokens, qt)) shared from (select *, list_distinct(string_split('{NAME}', ' ')) qt from texts) where text = '{NAME}' or len(list_intersect(tokens, qt)) > 0),
kinds as (select *, case when text = '{NAME}' then 'exact' when norm = '{NAME}' then 'normalized' when starts_with(norm, '{NAME}') then 'prefix' when shared = len(qt) then 'all_tokens' else 'partial' end kind from hit),
scored as (select *, case kind when 'exact' then 4.0 when 'normalized' then 3.5 when 'prefix' then 3.0 when 'all_tokens' then 2.5 else 1.0 + 0.5 * shared / len(qt) end :: double score from kinds),
best as (select * from (select *, row_number() over (partition by gid order by score desc, pos, text) n from scored) where n = 1)"""
_VEC = f"(select embedding from embeddings where vec_id = {QUERY_VECTOR_ID})"


def _score(metric: str, q: str = "q") -> tuple[str, str]:
    a, b = "embedding :: double[]", f"{q} :: double[]"
    return {"cosine": (f"list_cosine_similarity({a}, {b})", f"1 - list_cosine_similarity({a}, {b})"), "l2": (f"-list_distance({a}, {b})", f"list_distance({a}, {b})"), "dot": (f"list_inner_product({a}, {b})", f"-list_inner_product({a}, {b})")}[metric]


def _knn(metric: str, where: str = "true") -> str:
    s, d = _score(metric)
    return f"""select vec_id, round(s, 6) as score, round(d, 6) as distance, row_number() over (order by s desc, vec_id) :: int as "rank"
        from (select vec_id, {s} s, {d} d from (select *, {_VEC} q from embeddings) where {where} order by s desc, vec_id limit 10)"""


def _knn_join(metric: str, where: str = "true") -> str:
    s = _score(metric, "qv")[0]
    return f"""select query, id, round(s, 6) score, "rank" from (select q.vec_id query, e.vec_id id, {s} s, row_number() over (partition by q.vec_id order by {s} desc, e.vec_id) :: int as "rank"
        from embeddings e join (select vec_id, embedding qv from embeddings where vec_id % 100 = 0) q on q.vec_id <> e.vec_id where {where}) where "rank" <= 10"""


_COS, _L2, _DOT = _score("cosine")[0], _score("l2")[1], _score("dot")[0]
_SALES = f"""sales as (
  select {PLACE["Customer"] * BASE} + c_custkey src, {PLACE["Nation"] * BASE} + c_nationkey dst, 'IN_NATION' t from customer union all select {PLACE["Supplier"] * BASE} + s_suppkey, {PLACE["Nation"] * BASE} + s_nationkey, 'IN_NATION' from supplier
  union all select {PLACE["Nation"] * BASE} + n_nationkey, {PLACE["Region"] * BASE} + n_regionkey, 'IN_REGION' from nation)"""

_SEEN = "_created_lsn <= {0} and (_deleted_lsn is null or _deleted_lsn > {0})"
_SIDES = {"a": _SEEN.format(60_000), "b": _SEEN.format(120_000)}
_DIFF = f"""with n as (select distinct node_type as name, node_id id, '' id2, 'class' kind, 'a' side from node_store where {_SIDES["a"]} union select node_type, node_id, '', 'class', 'b' from node_store where {_SIDES["b"]}
        union select edge_type, coalesce(src :: varchar, 'null'), coalesce(dst :: varchar, 'null'), 'relation', 'a' from edge_store where {_SIDES["a"]} union select edge_type, coalesce(src :: varchar, 'null'), coalesce(dst :: varchar, 'null'), 'relation', 'b' from edge_store where {_SIDES["b"]}),
    p as (select kind, name, id, id2, count(distinct side) n, min(side) side from n group by all)
    select kind, name, sum((n = 1 and side = 'a') :: int) :: bigint only_a, sum((n = 1 and side = 'b') :: int) :: bigint only_b, sum((n = 2) :: int) :: bigint as "both", false schema_changed from p group by 1, 2"""

_WALKS = _W + _adj("'transferredTo'", "out") + f""", w1 as (select [{ACCOUNTS[0]} :: bigint, next] nodes, [eid] eids, [w] ws, next here from adj where node = {ACCOUNTS[0]} and next <> {ACCOUNTS[0]}),
    w2 as (select list_append(nodes, a.next) nodes, list_append(eids, a.eid) eids, list_append(ws, a.w) ws, a.next here from w1 join adj a on a.node = here where not list_contains(nodes, a.next)),
    w3 as (select list_append(nodes, a.next) nodes, list_append(eids, a.eid) eids, list_append(ws, a.w) ws, a.next here from w2 join adj a on a.node = here where not list_contains(nodes, a.next)),
    walks as (select *, len(eids) :: int depth from (select * from w1 union all select * from w2 union all select * from w3) where here = {ACCOUNTS[1]})"""

SQL = {
    "path_scores": _WALKS + """, s as (select 'average' as mode, *, list_sum(ws) / len(ws) score from walks union all select 'min', *, list_min(ws) from walks union all select 'max', *, list_max(ws) from walks)
        select mode, depth, nodes internal_node_ids, eids edge_ids, round(score, 6) path_score from (select *, row_number() over (partition by mode order by score desc, depth, nodes, eids) n from s) where n <= 5""",
    "shortest_path_deep": _WALKS + " select depth, nodes, eids from walks order by depth, nodes, eids limit 1",
    "neighbors_of_class": _W + _adj("'MENTIONS', 'RELATED_TO'", "out") + """, z as (select distinct gid from nodes where node_type = 'Chunk'), a1 as (select distinct next g from adj where node in (select gid from z) and next not in (select gid from z)),
        a2 as (select distinct next g from adj where node in (select g from a1) and next not in (select gid from z) and next not in (select g from a1))
        select coalesce(n.node_id, g :: varchar) node_id, g internal_id, depth from (select g, 1 as depth from a1 union all select g, 2 from a2) left join nodes n on n.gid = g""",
    "vector_search_boosted": _W + _adj(_K, "both") + f""", c as (select gid, node_id, list_cosine_similarity(embedding :: double[], {_VEC} :: double[]) s from nodes join embeddings on vec_id = gid where node_type = 'Chunk' order by s desc, gid limit 40),
        per as (select node gid, count(*) d, sum(w) w, bool_or(next in (7, 19)) :: int h from adj where node in (select gid from c) group by 1),
        t as (select gid, node_id, s, 0.001 * coalesce(d, 0) + 0.01 * coalesce(w, 0) + 0.25 * coalesce(h, 0) + 0.5 * greatest(0, (s > 0.5) :: int + coalesce(h, 0) - 1) b from c left join per using (gid))
        select gid, node_id, round(s + b, 6) score, round(s, 6) vector_score, round(b, 6) :: double graph_boost_score, row_number() over (order by s + b desc, gid) :: int as "rank" from t order by s + b desc, gid limit 10""",
    "ivf_recall": "select true as enough, count(*) * 10 as pairs from embeddings where vec_id % 100 = 0",
    "join_inner": "select c_custkey, c_name, o_orderkey, o_custkey from customer join orders on c_custkey = o_custkey",
    "join_probe_outer": """select nid, node_type, eid, src from (select distinct eid, src from edge_store where _deleted_lsn is null) e
        left join (select distinct nid, node_type from node_store where _deleted_lsn is null) n on n.nid is not distinct from e.src""",
    "join_null_safe": """select n.document_id, nodes, h.document_id hit_document_id, hits as hit_hits from (select document_id, count(distinct nid) nodes from node_store group by 1) n
        join (select document_id, count(distinct result_id) hits from graphrag_result group by 1) h on n.document_id is not distinct from h.document_id""",
    "agg_all_kernels": """select event_type, count(value) n_value, count(*) n, round(sum(value), 6) sum_value, min(value) min_value, max(value) max_value, round(avg(value), 6) mean_value, round(stddev_samp(value), 6) sd_value,
        round(quantile_cont(value, 0.5), 6) median_value, count(distinct user_id) users from events group by 1""",
    "agg_global": "select count(*) n, count(depth) with_depth, max(depth) max_depth, count(distinct search_id) searches from graphrag_result",
    "agg_collect": "select node_type, list(entity_type order by entity_type asc nulls last) kinds from (select distinct node_type, entity_type from node_store) group by 1",
    "topk_sorted": """select result_id, score, depth from graphrag_result
        order by case when score is null then 2 when isnan(score) then 1 else 0 end, score desc nulls last, depth asc nulls last, result_id limit 100 offset 10""",
    "union_all_drop_rename": "select c_name as name, c_nationkey nation from customer union all select s_name, s_nationkey from supplier",
    "expression_filter": "select p_partkey, p_brand, p_size from part where p_size > 10 and (p_brand in ('Brand#11', 'Brand#22', 'Brand#33') or not p_retailprice < 1200.0)",
    "degree_out": _W + "select src gid, count(*) degree from edges where edge_type = 'MENTIONS' and src is not null group by 1",
    "degree_in": _W + "select dst gid, count(*) degree from edges where edge_type = 'MENTIONS' and dst is not null group by 1",
    "degree_both_with_zero": _W + ", e as (select src gid from edges where edge_type = 'transferredTo' union all select dst from edges where edge_type = 'transferredTo') select n.gid, count(e.gid) degree from (select distinct gid from nodes where node_type = 'Account') n left join e using (gid) group by 1",
    "adjacent_edges": _W + """select src, dst, eid, 'out' as "end" from edges where edge_type = 'interactsWith' and src in (select gid from nodes where node_type = 'Gene')
        union all select src, dst, eid, 'in' from edges where edge_type = 'expressedIn' and dst in (select gid from nodes where node_type = 'Tissue')""",
    "common_neighbors": _W + _adj("'MENTIONS'", "out") + "select next gid from adj where node = 1 intersect select next from adj where node = 2",
    "overlap_topk": _W + _adj("'MENTIONS'", "out") + """, s as (select distinct node, next from adj where next in (select next from adj where node = 1))
        select gid, count(next) overlap from (select distinct gid from nodes where node_type = 'Chunk') n left join s on s.node = n.gid group by 1 order by 2 desc, 1 limit 50""",
    "top_edges_per_node": _W + _adj(_K, "both") + _top(3) + "select node, next, edge_type, eid, direction, w from best",
    "edge_filters": _W + ", m as (select eid, max(metric) metric from edge_store group by 1) select src node, dst as next, eid from edges join m using (eid) where edge_type = 'SEMANTIC_NEIGHBOR' and weight >= 0.5 and weight < 0.9 and metric = 'cosine' and src is not null and dst is not null",
    "neighbors_bfs": _W + _adj(_K, "out") + _LEVELS % (_SEED_ROWS, "0.0", "adj", 2) + "select coalesce(n.node_id, here :: varchar) node_id, n.node_type, here internal_id, depth, via_edge_id, via_edge_type from found left join nodes n on n.gid = here where depth > 0",
    "neighbors_scored": _W + _adj(_K, "both") + _top(5) + _LEVELS % (_SEED_ROWS, "-a.w", "best", 2) + "select here internal_id, depth, round(prod, 6) path_score from found join nodes n on n.gid = here where depth > 0 and node_type = 'Chunk' order by prod desc, depth, here limit 100",
    "k_hop_nodes": _W + _adj("'interactsWith', 'expressedIn'", "both") + _LEVELS % (_SEED_ROWS, "0.0", "adj", 2) + "select here internal_id, depth from found",
    "k_hop_edges": _W + _adj("'interactsWith', 'expressedIn'", "both") + _LEVELS % (_SEED_ROWS, "0.0", "adj", 2) + "select edge_type, eid, min(depth) + 1 as depth, min(src) src, min(dst) dst from found join adj on adj.node = found.here where depth < 2 group by 1, 2",
    "reachability": f"with recursive {_SALES}, r as (select {PLACE['Customer'] * BASE} + c_custkey seed, {PLACE['Customer'] * BASE} + c_custkey dst, 0 hop from customer union all select r.seed, s.dst, hop + 1 from r join sales s on s.src = r.dst where hop < 3) select seed, dst, min(hop) hop from r group by 1, 2",
    "reachable_per_depth": _W + _adj(_K, "out") + f", r as (select gid seed, gid node, 0 depth from (values {_SEED_ROWS}) s(pos, gid) union select r.seed, a.next, depth + 1 from r join adj a on a.node = r.node where depth < 2) select seed :: bigint seed, node :: bigint node, depth from r where depth > 0",
    "simple_paths_scored": _W + _adj("'MENTIONS', 'RELATED_TO'", "out") + _paths("(0, 1)", "adj", 2) + "select depth, nodes internal_node_ids, eids edge_ids, round(total, 6) path_score from walk where here = 13 and depth > 0 order by total desc, depth, nodes, eids limit 50",
    "multi_seed_paths": _W + _adj(_K, "out") + _paths(_SEED_ROWS, "adj", 2) + """select seed, here target, depth, round(prod, 6) score, eids path_edge_ids from (select *, row_number() over (partition by seed order by prod desc, depth, here, eids) n
        from walk where depth > 0 and here in (select gid from nodes where node_type = 'Chunk')) where n <= 10""",
    "shortest_path": _W + _adj(_K, "both") + _paths("(0, 7)", "adj", 2) + "select depth, nodes, eids from walk where here = 13 and depth > 0 order by depth, nodes, eids limit 1",
    "sample_first": _W + _adj(_K, "both") + f""", l0 as (select * from (select *, row_number() over (partition by node, edge_type order by eid) n from adj where node in ({", ".join(map(str, SEEDS))})) where n <= 4),
        l1 as (select * from (select *, row_number() over (partition by node, edge_type order by eid) n from adj where node in (select next from l0)) where n <= 2)
        select node src, next dst, edge_type, eid, 0 layer from l0 union all select node, next, edge_type, eid, 1 from l1""",
    "closure_scan": f"""select {PLACE["Nation"] * BASE} + n_nationkey as gid, 'nation/' || n_nationkey node_id, 'local:Nation' class_iri from nation union all select {PLACE["Region"] * BASE} + r_regionkey, 'region/' || r_regionkey, 'local:Region' from region""",
    "closure_pairs": "select * from (values ('Agent', 'Agent'), ('Place', 'Place'), ('Region', 'Region'), ('Place', 'Region'), ('Nation', 'Nation'), ('Place', 'Nation'), ('Customer', 'Customer'), ('Agent', 'Customer'), ('Supplier', 'Supplier'), ('Agent', 'Supplier'), ('Part', 'Part'), ('Order', 'Order')) t(ancestor, descendant)",
    "infer_symmetric": _W + ", e as (select distinct src, dst from edges where edge_type = 'interactsWith' and src is not null and dst is not null) select dst src, src dst from e except select src, dst from e",
    "infer_transitive": f"with recursive {_SALES}, r as (select src, dst from sales union select r.src, s.dst from r join sales s on s.src = r.dst) select src, dst from r except select src, dst from sales",
    "triple_constant": _W + "select dst o from edges where edge_type = 'RELATED_TO' and src = 5",
    "triple_pattern_join": f"select {PLACE['Nation'] * BASE} + n_nationkey n, {PLACE['Customer'] * BASE} + c_custkey c, {PLACE['Order'] * BASE} + o_orderkey o from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where n_regionkey = 1",
    "vector_functions": f"""select vec_id, round({_DOT} / ((sqrt(list_inner_product(embedding :: double[], embedding :: double[])) + 1e-12) * (sqrt(list_inner_product(q :: double[], q :: double[])) + 1e-12)), 6) similarity, round({_COS}, 6) cosine_similarity,
        round(1 - {_COS}, 6) cosine_distance, round({_DOT}, 6) dot_product, round({_L2}, 6) l2_distance, round(sqrt(list_inner_product(embedding :: double[], embedding :: double[])), 6) vec_norm, 1.0 :: double as unit from (select *, {_VEC} q from embeddings)""",
    "knn_join": f"""select query, id, round(s, 6) score, "rank" from (select q.vec_id query, e.vec_id id, {_score("cosine", "qv")[0]} s, row_number() over (partition by q.vec_id order by {_score("cosine", "qv")[0]} desc, e.vec_id) :: int as "rank"
        from embeddings e join (select vec_id, embedding qv from embeddings where vec_id % 100 = 0) q on q.vec_id <> e.vec_id) where "rank" <= 10""",
    "text_search": _W + _HITS + """ select gid, property, text, kind, round(score, 6) score, row_number() over (order by score desc, gid, property, text) :: int as "rank" from best order by score desc, gid, property, text limit 20""",
    "token_index": _W + _ENTRIES + ", t as (select gid, unnest(tokens) token from texts) select token, count(distinct gid) documents, count(*) texts from t group by 1",
    "link_entities": _W + _HITS + """, top as (select * from best order by score desc, gid, property, text limit 20),
        lex as (select gid, kind, text, score * case when kind in ('exact', 'normalized') and property = 'canonical_name' then 1.0 when kind in ('exact', 'normalized') and property = 'aliases' then 0.9 when kind in ('exact', 'normalized') then 1.0 else 0.45 end l from top),
        steps as (select src node, dst as next from edges union all select dst, src from edges),
        prior as (select node gid, count(*) d, count(distinct n.gid) c from steps left join (select gid from nodes where node_type = 'Chunk') n on n.gid = steps.next where node in (select gid from lex) and next is not null group by 1),
        total as (select gid, kind, text, l, coalesce(0.05 * d / (1.0 + d), 0) + coalesce(0.15 * c / (1.0 + c), 0) p from lex left join prior using (gid))
        select gid, round(l + p, 6) score, row_number() over (order by l + p desc, gid) :: int as "rank", kind, text, round(l, 6) lexical_score, 0.0 :: double semantic_score, round(p, 6) graph_prior_score from total order by l + p desc, gid limit 5""",
    "evidence_search": _W + _adj(_K, "both") + _top(24) + _paths(_SEED_ROWS, "best", 2, "and (depth = 0 or here not in (select gid from nodes where node_type = 'Chunk'))") + f""",
        s as (select w.*, 0.55 * prod + 0.30 / (1 + pos) - 0.15 * depth score from walk w join (values {_SEED_ROWS}) v(pos, gid) on v.gid = w.seed where depth > 0 and here in (select gid from nodes where node_type = 'Chunk')),
        a as (select * from (select *, row_number() over (partition by seed order by score desc, depth, here, seed, eids) n from s) where n <= 8),
        b as (select * from (select *, row_number() over (partition by here order by score desc, depth, here, seed, eids) m from a) where m = 1)
        select here target, seed, round(score, 6) score, row_number() over (order by score desc, depth, here, seed, eids) :: int as "rank", depth, round(prod, 6) path_score, eids path_edge_ids from b order by score desc, depth, here, seed, eids limit 36""",
    "as_of_nodes": "select node_type, count(distinct nid) as nodes from node_store where _created_lsn <= 50000 and (_deleted_lsn is null or _deleted_lsn > 50000) group by 1",
    "as_of_edges": "select distinct eid, src node, dst as next from edge_store where edge_type = 'RELATED_TO' and src is not null and dst is not null and _created_lsn <= 20000 and (_deleted_lsn is null or _deleted_lsn > 20000)",
    "bundle_diff": _DIFF,
    "feature_lookup": _W + """, d as (select dst gid, count(*) degree from edges where edge_type = 'MENTIONS' and dst is not null group by 1)
        select gid, degree from (select distinct try_cast(regexp_extract(target_node_id, '([0-9]+)$', 1) as bigint) gid from graphrag_result) t left join d using (gid) where gid is not null""",
    "event_windows": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 6) total from events group by 1, 2",
    "knn_cosine": _knn("cosine"),
    "knn_l2": _knn("l2"),
    "knn_dot": _knn("dot"),
    "knn_filtered": _knn("cosine", "label = 3"),
    "knn_join_l2": _knn_join("l2"),
    "knn_join_dot": _knn_join("dot"),
    "knn_join_filtered": _knn_join("cosine", "label = 3"),
}
