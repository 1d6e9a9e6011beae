"""DuckDB SQL that gives the rows of the queries in `data_processing`, by plainer means."""

_ORPHANS = """
with v as (select nid, _created_lsn a, coalesce(_deleted_lsn, 9223372036854775807) b from node_store),
first as (select nid, min(a) a from v group by nid),
refs as (select eid, edge_type, ingested_at, 'src' as endpoint, src k, _created_lsn t from edge_store where src is not null
         union all select eid, edge_type, ingested_at, 'dst', dst, _created_lsn from edge_store where dst is not null),
orphans as (select r.*, case when f.nid is null then 'missing' when f.a > t then 'late' else 'deleted' end as reason
            from refs r left join first f on f.nid = r.k where not exists (select 1 from v where v.nid = r.k and v.a <= t and t < v.b))
"""

_CHANGES = """
with w as (select bundle, lsn, coalesce(prev_lsn, -1) p, list_sort(list_filter(regexp_split_to_array(lower(kind), '[^a-z]+'), lambda x: x <> '')) k, try_cast(try(decode(payload)) as json) j from wal_record),
lsns as (select bundle, lsn, count(distinct p) n, lag(lsn, 1, 0) over (partition by bundle order by lsn) before from w group by bundle, lsn),
good as (select w.*, coalesce(j->>'$.tx_id', j->>'$.txId', j->>'$.tx.id') tx from w join lsns using (bundle, lsn) where j is not null and (n = 1 or p = before)),
done as (select distinct bundle, tx from good where k = ['commit', 'tx']),
nodes as (select bundle, lsn, k[1] || k[2] op, j, regexp_extract(coalesce(j->>'$.class', j->>'$.node.class', regexp_extract(j->>'$.target', '^(.*)/[^/]*$', 1)), '([^/#:]*)$', 1) class_name
          from good where k in (['insert', 'node'], ['node', 'upsert'], ['node', 'update'], ['delete', 'node']) and (tx is null or (bundle, tx) in (select bundle, tx from done))),
changes as (
  select bundle, lsn, op, class_name, coalesce(j->>'$.nid', j->>'$.node.nid', regexp_extract(j->>'$.target', '([^/]*)$', 1)) :: bigint nid, j->'$.props' props, 0 pos from nodes where coalesce(j->>'$.nid', j->>'$.node.nid', j->>'$.target') is not null
  union all select bundle, lsn, op, class_name, (r->>'$.nid') :: bigint, r->'$.props', pos from (select *, unnest(from_json(j->'$.rows', '["json"]')) r, generate_subscripts(from_json(j->'$.rows', '["json"]'), 1) pos from nodes where json_exists(j, '$.rows'))
  union all select bundle, lsn, op, class_name, (r->>'$') :: bigint, null, 0 from (select *, unnest(from_json(j->'$.nids', '["json"]')) r from nodes where json_exists(j, '$.nids'))),
epochs as (select *, sum((op = 'deletenode') :: int) over (partition by bundle, class_name, nid order by lsn) epoch from changes),
alive as (select *, max(epoch) over (partition by bundle, class_name, nid) last_epoch, sum((op in ('insertnode', 'nodeupsert')) :: int) over (partition by bundle, class_name, nid, epoch order by lsn) starts from epochs),
took as (select * from alive where epoch = last_epoch and starts > 0 and op <> 'deletenode')
"""

_ENDS = """
with one as (select eid, max(src) src, max(dst) dst, max(weight) weight from edge_store where eid is not null group by eid),
ends as (select 'src' as endpoint, src nid, weight from one union all select 'dst', dst, weight from one)
"""


def _file(folder: str) -> str:
    steps = "list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x not in ('', '.'))"
    full = f"list_reduce(list_prepend('/{folder}/' || local_name, {steps}), lambda acc, x: case when x = '..' then regexp_replace(acc, '/[^/]*$', '') else acc || '/' || x end)"
    return f"regexp_extract({full}, '^.*/{folder}/' || local_name || '/(.*)$', 1)"


_REFS = f"""
with raw as (select 'node' as store_kind, local_name store, chunk_id, {_file("nodes")} file, start_nid s, end_nid e, coalesce(n_bytes, 0) n from node_chunk
             union all select 'edge', local_name, chunk_id, {_file("edges")}, start_eid, end_eid, coalesce(n_bytes, 0) from edge_chunk),
known as (select store_kind, store, file, arg_min(s, chunk_id) s, arg_min(e, chunk_id) e from raw where s is not null and e is not null group by all),
refs as (select r.store_kind, r.store, chunk_id, r.file, case when r.s is null or r.e is null then k.s else r.s end s, case when r.s is null or r.e is null then k.e else r.e end e, n from raw r left join known k using (store_kind, store, file)),
ranged as (select *, max(e) over (partition by store_kind, store order by s range between unbounded preceding and 1 preceding) as before from refs where s < e),
marked as (select r.*, exists (select 1 from ranged o where o.store_kind = r.store_kind and o.store = r.store and o.s <= r.s and o.e >= r.e and (o.e - o.s > r.e - r.s or o.chunk_id < r.chunk_id)) covered from ranged r),
kept as (select *, coalesce(sum(n) over (partition by store_kind, store order by s rows between unbounded preceding and 1 preceding), 0) :: bigint ahead from marked where not covered),
boxed as (select *, ahead // 134217728 as container, min(ahead) over (partition by store_kind, store, ahead // 134217728) base from kept),
plan as (
  select store_kind, store, chunk_id, file, 'copied' as state, container, ahead - base as "offset", n as length, greatest(s, before) take_start, e take_stop from boxed
  union all select store_kind, store, chunk_id, file, 'covered', null, null, null, null, null from marked where covered
  union all select store_kind, store, chunk_id, file, case when s is null or e is null then 'unknown' else 'empty' end, null, null, null, null, null from refs where s is null or e is null or s >= e)
"""

SQL = {
    "p2_found": _ORPHANS + "select distinct eid, endpoint, reason from orphans",
    "p2_report": _ORPHANS + """, one as (select eid, endpoint, reason, min(ingested_at) f, min(edge_type) edge_type from orphans group by all)
        select edge_type, endpoint, strftime(f, '%Y-%m') as month, reason, count(*) :: bigint as "references" from one group by all""",
    "p3_found": _CHANGES + "select bundle, class_name, nid, max(lsn) lsn from took group by all",
    "p3_state": _CHANGES + """, resets as (select bundle, class_name, nid, max(lsn) filter (where op = 'insertnode') r from took group by all),
        f as (select took.*, unnest(json_keys(props)) as field from took join resets using (bundle, class_name, nid) where r is null or lsn >= r),
        v as (select *, json_extract_string(props, '$."' || field || '"') x, json_type(props, '$."' || field || '"') t from f)
        select bundle, class_name, nid, field, arg_max_null(case when t = 'DOUBLE' then rtrim(rtrim(x, '0'), '.') else x end, lsn * 100000 + pos) as value, max(lsn) set_at from v group by all""",
    "p3_typed": _CHANGES + """, resets as (select bundle, class_name, nid, max(lsn) filter (where op = 'insertnode') r from took group by all),
        f as (select took.*, unnest(json_keys(props)) as field from took join resets using (bundle, class_name, nid) where r is null or lsn >= r),
        v as (select bundle, class_name, nid, field, arg_max(struct_pack(t := json_type(props, '$."' || field || '"'), x := json_extract_string(props, '$."' || field || '"')), lsn * 100000 + pos) w, max(lsn) set_at from f group by all),
        k as (select *, case w.t when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'OBJECT' then 'object' when 'ARRAY' then 'object' else 'number' end kind from v)
        select bundle, class_name, nid, field, set_at, kind, case when kind = 'string' then w.x end as text, case when kind = 'number' then try_cast(w.x as double) end number from k""",
    "p4_totals": _ENDS + "select endpoint, nid, count(*) :: bigint edges, sum(case when not isnan(weight) then weight :: double end) weight_sum from ends group by all",
    "p4_found": _ENDS + "select endpoint, nid from ends where nid is not null group by all having count(*) * 100 >= (select count(*) from one)",
    "p5_plan": _REFS + "select * from plan",
    "p5_found": _REFS + "select store_kind, chunk_id from plan where state = 'covered'",
    "p5_packed": """select 'documents/' || coalesce(lang, '-') || '/' || doc_id as path, strlen(coalesce(text, '')) :: bigint length, md5(coalesce(text, '')) digest from documents""",
    "p5_containers": _REFS + """select store_kind, store, container, count(*) :: bigint files, sum(length) :: bigint bytes, sum(take_stop - take_start) :: bigint ids from plan where state = 'copied' group by all""",
}
