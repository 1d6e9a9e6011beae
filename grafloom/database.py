"""A database of one property graph: definitions, ingest, upserts, snapshots, indexes and queries."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _infer_type

from grafloom import observability
from grafloom.catalog import Catalog, IndexDef, local_name
from grafloom.errors import GraphError
from grafloom.functions.prefix import running_before
from grafloom.graph import CREATED, DELETED, PropertyGraph, union_all
from grafloom.graph_api import GraphApi, Result
from grafloom.lang.compiler import Compiler, compile_query
from grafloom.lang.parser import Clause, Node, Pattern, Query, Statement, parse
from grafloom.operators import indexes, ontology, text, traverse, vector
from grafloom.plans.runtime import IN_KEYS, among, few, keep
from grafloom.sources import export, ingest
from grafloom.storage import Store, read_text, write_text

OPEN = {"nid", "gid", CREATED, DELETED}


@dataclass(frozen=True)
class ResourceRef:
    external_id: str
    gid: int
    node_type: str
    iri: str


class NodeQuery:
    """`db.nodes("C").where(x=1).select("y")`: equality filters, where None means IS NULL."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def where(self, **equal) -> NodeQuery:  # noqa: ANN003
        df = self.df
        for k, v in equal.items():
            if k not in df.columns:
                raise GraphError(6020, f"no column {k}")
            df = df.where(F.col(k).isNull() if v is None else F.col(k) == v)
        return NodeQuery(df)

    def select(self, *columns: str) -> NodeQuery:
        return NodeQuery(self.df.select(*columns))

    def rows(self) -> list[dict]:
        return Result(self.df).rows()

    def arrow(self):  # noqa: ANN201
        return self.df.toArrow()

    def count(self) -> int:
        return self.df.count()

    def first(self) -> dict | None:
        got = self.df.limit(1).collect()
        return got[0].asDict(recursive=True) if got else None


class Database(GraphApi):
    """A graph that is kept as Parquet files which are only added to (see `Store`) below `path`, a folder or URI that all
    executors share; a manifest names the files in use and is replaced whole, so a reader sees one state or the one
    before. A commit fails if another writer has replaced it since. Without a path it lives in the checkpoint folder."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.catalog, self.snapshots, self.lsn, self.next_gid, self.next_eid = Catalog(), {}, 0, 0, {}
        self.store, self._graph, self._saved, self._manifest = Store(spark, path), None, None, None
        self._built: dict[str, tuple] = {}
        self.tracer = observability.Tracer()
        text = read_text(spark, f"{path}/manifest.json") if path else None
        if text:
            self._restore(text)
            self._manifest = text

    # --- state

    def _state(self) -> str:
        return json.dumps({"snapshots": self.snapshots, "lsn": self.lsn, "next_gid": self.next_gid, "next_eid": self.next_eid, "tables": self.store.files, "catalog": self.catalog.to_json()})

    def _restore(self, text: str) -> None:
        d = json.loads(text)
        self.snapshots, self.lsn, self.next_gid, self.next_eid = d["snapshots"], d["lsn"], d["next_gid"], d["next_eid"]
        self.catalog, self.store, self._graph = Catalog.from_json(d["catalog"]), Store(self.spark, self.store.folder, d["tables"]), None

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {n: self.store.get(n) for n in self.store.names()}

    @property
    def graph(self) -> PropertyGraph:
        if self._graph is None:
            part = lambda kind: {k.split("/", 1)[1]: df for k, df in self.tables.items() if k.startswith(kind)}
            self._graph = PropertyGraph(self.spark, part("nodes/"), part("edges/"), self.catalog, None, self.snapshots)
        return self._graph

    def commit(self) -> None:
        """Makes the state so far the one that is found when the folder is opened; inside a transaction, nothing yet."""
        self._graph = None
        if self.path is None or self._saved is not None:
            return
        if read_text(self.spark, f"{self.path}/manifest.json") != self._manifest:
            raise GraphError(8002, "another writer has changed the database")
        self._manifest = self._state()
        write_text(self.spark, f"{self.path}/manifest.json", self._manifest)

    def begin(self) -> None:
        """Starts a transaction: what follows is kept from others until `commit_transaction`."""
        if self._saved is not None:
            raise GraphError(8001, "a transaction is open")
        self._saved = self._state()

    def commit_transaction(self) -> None:
        """The first of several writers to commit wins; for the others this is an error, and their changes are undone."""
        if self._saved is None:
            raise GraphError(8001, "no transaction is open")
        saved, self._saved = self._saved, None
        try:
            self.commit()
        except GraphError:
            self._restore(saved)
            raise

    def rollback(self) -> None:
        if self._saved is None:
            raise GraphError(8001, "no transaction is open")
        self._restore(self._saved)
        self._saved = None

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        """`with db.transaction(): ...` commits at the end, and undoes all of it on an error."""
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit_transaction()

    def _versioned(self, df: DataFrame) -> DataFrame:
        return df.withColumns({CREATED: F.lit(self.lsn).cast("long"), DELETED: F.lit(None).cast("long")})

    def _append(self, name: str, df: DataFrame) -> None:
        old = self.store.get(name)
        if old is not None:
            have, new = dict(old.dtypes), dict(df.dtypes)
            wrong = sorted(c for c, t in new.items() if have.get(c, t) != t)
            if wrong:
                raise GraphError(7011 if name.startswith("nodes") else 7021, f"{name} has other types of {', '.join(wrong)}: {have}, not {new}")
        self.store.append(name, self._versioned(df))
        self._graph = None

    def frame(self, data: DataFrame | Iterable[dict]) -> DataFrame:
        if isinstance(data, DataFrame):
            return data
        if hasattr(data, "column_names"):  # Arrow; unsigned integers have no Spark type
            import pyarrow as pa

            return self.spark.createDataFrame(data.cast(pa.schema([pa.field(f.name, pa.int64() if pa.types.is_unsigned_integer(f.type) else f.type) for f in data.schema])))
        rows = list(data)
        names = list(dict.fromkeys(k for r in rows for k in r))
        columns = [[r.get(k) for r in rows] for k in names]
        # A column of nulls only has no type of its own; text takes any.
        types = {n: StringType() if all(x is None for x in c) else _infer_type(next(x for x in c if x is not None)) for n, c in zip(names, columns, strict=True)}
        for n, c in zip(names, columns, strict=True):
            if types[n].typeName() == "long" and any(isinstance(x, float) for x in c):
                types[n] = _infer_type(1.0)
        cast = lambda x, t: float(x) if t.typeName() == "double" and isinstance(x, int) else x
        return self.spark.createDataFrame([tuple(cast(r.get(k), types[k]) for k in names) for r in rows], StructType([StructField(n, types[n]) for n in names]))

    def _batch(self, data, *ids: str) -> DataFrame:  # noqa: ANN001
        """The rows of a call with their order in `_row`, written once; `ids` are text."""
        df = self.frame(data)
        missing = [c for c in ids if c not in df.columns]
        if missing:
            raise GraphError(7011, f"no column {', '.join(missing)}")
        return keep(df.drop(*OPEN).withColumns({c: F.col(c).cast("string") for c in ids}).withColumn("_row", F.monotonically_increasing_id()))

    # --- definitions

    def define_class(self, name: str, iri: str | None = None, parents: list[str] | None = None):  # noqa: ANN201
        return self.catalog.define_class(name, iri, parents)

    def execute(self, script: str, params: dict | None = None) -> list:
        """Runs statements; queries give a `Result`, updates and deletes the number of nodes and edges."""
        out = []
        for s in parse(script):
            got = Result(Compiler(self.graph, params, self._vector_indexes()).run(s)) if isinstance(s, Query) else self._statement(s, params)
            if got is not None:
                out.append(got)
        return out

    def _statement(self, s: Statement, params: dict | None):  # noqa: ANN202
        d = s.data
        if s.kind == "prefix":
            self.catalog.prefixes[d["name"]] = d["iri"]
        elif s.kind == "create_class":
            return self.catalog.define_class(local_name(d["name"]), d["name"] if ":" in d["name"] else None, d["parents"], d["fields"], d["required"])
        elif s.kind == "create_property":
            return self.catalog.define_property(local_name(d["name"]), kind=d["kind"], characteristics=d["characteristics"], domain=d["domain"], range=d["range"])
        elif s.kind == "create_snapshot":
            self.create_snapshot(d["name"])
        elif s.kind == "create_index":
            return self._create_index(d)
        elif s.kind == "drop_index":
            self.drop_index(d["name"])
        elif s.kind == "insert":
            values = {k: v[1] for k, v in d["props"].items() if v[0] == "lit"}
            missing = [r for r in self.catalog.find(d["class"]).required if r not in values]
            if missing or len(values) != len(d["props"]):
                raise GraphError(9501, f"{d['class']} needs literals for {missing or list(d['props'])}")
            self.insert_nodes(d["class"], [values])
        elif s.kind == "insert_triples":
            self.insert_triples([tuple(x[1] for x in t) for t in d["triples"]])
        elif s.kind == "infer":
            return self.infer_closure(d["names"])
        elif s.kind in ("explain", "profile"):
            return (self.explain_query if s.kind == "explain" else self.profile_query)(d["query"])
        elif s.kind == "update":
            return self._update(d["query"], d["sets"], params)
        elif s.kind == "delete":
            return self._delete(d["query"], d["aliases"], params)
        elif s.kind == "merge":
            return self._merge_node(d, params)
        elif s.kind == "export":
            return self._export(d)
        else:
            {"begin": self.begin, "commit": self.commit_transaction, "rollback": self.rollback}[s.kind]()
        return None

    def _create_index(self, d: dict) -> IndexDef:
        cls = self.catalog.find(d["class"]).name
        name, options = d["name"] or f"{cls}_{'_'.join(d['columns'])}_{d['kind'].lower()}", d["options"]
        if d["kind"] in ("HNSW", "IVF", "VECTOR"):
            size = options.get("dim") or options.get("dimension") or self.graph.nodes(cls).where(F.col(d["columns"][0]).isNotNull()).select(F.size(d["columns"][0])).first()[0]
            return self.create_vector_index(name, cls, d["columns"][0], size, options.get("metric", "cosine"))
        if d["kind"] in ("TEXT", "FULLTEXT"):
            return self.create_text_index(name, cls, d["columns"])
        if d["kind"] in ("BTREE", "HASH", "BITMAP", "PROPERTY"):
            return self.create_property_index(name, cls, d["columns"][0])
        raise GraphError(7090, f"unknown kind of index {d['kind']}")

    def _found(self, q: Query, params: dict | None) -> Compiler:
        c = Compiler(self.graph, params, self._vector_indexes())
        c.body(q)
        return c

    def _tables_of(self, c: Compiler, alias: str) -> tuple[str, list[str]]:
        """The key of an alias's rows, and the tables that may hold them."""
        if alias in c.labels:
            return "gid", [f"nodes/{n}" for n in c.labels[alias]]
        if alias in c.edges:
            return "eid", [t for t in self.store.names() if t.startswith("edges/")]
        raise GraphError(3001, f"unknown name {alias}")

    def _update(self, q: Query, sets: list[tuple[tuple, tuple]], params: dict | None) -> int:
        """New versions of the matched nodes and edges with the given values, all computed from the state before. Of
        several values for one row the greatest counts."""
        c = self._found(q, params)
        rows = keep(c._with_degrees([e for _, e in sets], c.df))
        c.df, n, todo = rows, 0, []
        for alias in dict.fromkeys(t[1][0] for t, _ in sets):
            key, tables = self._tables_of(c, alias)
            new = {t[1][1]: c.expr(e) for t, e in sets if t[1][0] == alias}
            if {"gid", "eid", "node_id", "src", "dst"} & set(new):
                raise GraphError(6020, "ids can't be set")
            which = [F.col(f"`{alias}.type`").alias("t_")] if key == "eid" else []
            per = rows.select(F.col(f"`{alias}.{key}`").alias(key), *which, *[v.alias(k) for k, v in new.items()]).where(F.col(key).isNotNull())
            todo.append((key, tables, keep(per.groupBy(key, *["t_"] * len(which)).agg(F.max(F.struct(*new)).alias("v")).select(key, *["t_"] * len(which), "v.*"))))
        self.lsn += 1
        for key, tables, batch in todo:
            for t in tables:
                mine = batch.where(F.col("t_") == t.split("/", 1)[1]).drop("t_") if "t_" in batch.columns else batch
                live, types = self.store.get(t).where(F.col(DELETED).isNull()), dict(self.store.get(t).dtypes)
                mine = keep(mine.join(live.select(key), key, "left_semi").select(*[F.col(x).cast(types[x]).alias(x) if x in types else x for x in mine.columns]))
                count = mine.count()
                if count:
                    n += count
                    self._merge(t, mine, key, [t])
        self.commit()
        return n

    def _delete(self, q: Query, aliases: list[str], params: dict | None) -> int:
        """Ends the matched nodes, with their edges, and edges. The number of those named, without the nodes' edges."""
        c, n = self._found(q, params), 0
        rows, todo = keep(c.df), []
        for alias in aliases:
            key, tables = self._tables_of(c, alias)
            todo.append((key, tables, rows.select(F.col(f"`{alias}.{key}`").alias(key), *([F.col(f"`{alias}.type`").alias("t_")] if key == "eid" else [])).where(F.col(key).isNotNull()).distinct()))
        for key, tables, ids in todo:
            if key == "gid":
                n += sum(self.delete_nodes(t.split("/", 1)[1], ids) for t in tables)
                continue
            self.lsn += 1
            for t in tables:
                mine = ids.where(F.col("t_") == t.split("/", 1)[1]).select(key)
                gone = keep(self.store.get(t).where(F.col(DELETED).isNull()).join(mine, key, "left_semi"))
                count = gone.count()
                if count:
                    n += count
                    self.store.end(t, gone, self.lsn)
            self.commit()
        return n

    def _merge_node(self, d: dict, params: dict | None) -> dict[str, int]:
        """Sets values of the nodes that match, or makes one with the properties of the pattern."""
        node = d["node"]
        alias = node.alias or "n"
        c = Compiler(self.graph, params)
        name = self.catalog.define_class(local_name(node.labels[0])).name if node.labels else None
        if name is None:
            raise GraphError(6020, "MERGE takes a label")
        q = Query([Clause("match", [Pattern(None, [Node(alias, node.labels, node.props)], [])])])
        if f"nodes/{name}" in self.store.files and not self._found(q, params).df.isEmpty():
            return {"created": 0, "matched": self._update(q, d["match"], params) if d["match"] else self._found(q, params).df.count()}
        values = {k: c._constant(v) for k, v in node.props.items()} | {t[1][1]: c._constant(e) for t, e in d["create"]}
        if "node_id" in values:
            self.insert_node_table([values | {"type": name}])
        else:
            self.insert_nodes(name, [values])
        return {"created": 1, "matched": 0}

    def _export(self, d: dict) -> list[str]:
        g = self.graph
        classes = [self.catalog.find(n).name for n in d["nodes"]] if d["nodes"] is not None else (list(g.stored_nodes) if d["edges"] is None else [])
        relations = [local_name(n) for n in d["edges"]] if d["edges"] is not None else (list(g.stored_edges) if d["nodes"] is None else [])
        if d["format"] == "PARQUET":
            return export.export_parquet(g, d["path"], classes, relations)
        if d["format"] != "ARROW":
            raise GraphError(6160, f"unknown format {d['format']}")
        tables = {f"nodes/{n}": g.nodes(n) for n in classes} | {f"edges/{n}": g.edges(n) for n in relations}
        export.export_arrow(tables, d["path"])
        return list(tables)

    # --- ingest

    def _gids(self, keys: DataFrame) -> DataFrame:
        """`key_`, `gid` for distinct new keys: dense numbers after those in use, in order of hash and key."""
        k = keep(keys.where("key_ is not null").distinct().select("key_", F.xxhash64("key_").alias("h")))
        got = k.limit(IN_KEYS + 1).collect()
        if len(got) <= IN_KEYS:
            n, rows = len(got), sorted((r["h"], r["key_"]) for r in got)
            out = self.spark.createDataFrame([(key, self.next_gid + i) for i, (_, key) in enumerate(rows)], "key_ string, gid bigint")
        else:  # the same numbers, block by block
            n = k.count()
            out = running_before(k.withColumn("one", F.lit(1)), [], F.shiftright("h", 52), [F.col("h"), F.col("key_")], {"n": ("sum", "one")})
            out = keep(out.select("key_", (F.coalesce("n", F.lit(0)) + self.next_gid).alias("gid")))
        self.next_gid += n
        return out

    def _index(self, keys: list[str] | None = None) -> DataFrame:
        """`node_id`, `gid`, `node_type` of the current nodes that have an external id, of `keys` only if given."""
        parts = [self.graph.nodes(n).select(F.col("node_id").cast("string"), "gid", F.lit(n).alias("node_type")) for n, df in self.graph.stored_nodes.items() if "node_id" in df.columns]
        if not parts:
            return self.spark.createDataFrame([], "node_id string, gid bigint, node_type string")
        return union_all([p if keys is None else p.where(among("node_id", keys)) for p in parts])

    def _known(self, batch: DataFrame, *columns: str) -> DataFrame:
        """The index of the nodes that `batch` names in `columns`, one row per id."""
        named = reduce(DataFrame.union, [batch.select(F.col(c).alias("node_id")) for c in columns])
        keys = few(named, "node_id")
        index = self._index(keys)
        if keys is None:
            index = index.join(named.distinct(), "node_id", "left_semi")
        return keep(index.groupBy("node_id").agg(F.min(F.struct("gid", "node_type")).alias("x")).select("node_id", "x.*"))

    def insert_nodes(self, cls: str, data) -> int:  # noqa: ANN001
        """Nodes of a defined class, without external id."""
        name = self.catalog.find(cls).name
        self.lsn += 1
        df = self._batch(data).withColumn("key_", F.col("_row").cast("string")).drop("_row")
        before = self.next_gid
        self._append(f"nodes/{name}", df.join(self._gids(df.select("key_")), "key_").drop("key_"))
        self.commit()
        return self.next_gid - before

    def insert_node_table(self, data, key: str = "node_id", type_col: str = "type") -> int:  # noqa: ANN001
        """Rows of any classes, grouped by type; a key seen before keeps its gid and gets a further row. A row without
        key or type is an error, and then nothing is inserted. Returns the number of rows."""
        df = self._batch(data, key, type_col)
        n, bad = df.agg(F.count("*"), F.count_if(F.col(key).isNull() | F.col(type_col).isNull())).first()
        if bad:
            raise GraphError(7011, f"{bad} of {n} rows have no {key} or {type_col}")
        self.lsn += 1
        known = self._known(df, key).select(F.col("node_id").alias("key_"), "gid")
        ids = known.unionByName(self._gids(df.select(F.col(key).alias("key_")).join(known, "key_", "left_anti")))
        rows = keep(df.join(ids, F.col(key) == F.col("key_")).drop("key_", "_row").withColumnRenamed(key, "node_id"))
        for (t,) in rows.select(type_col).distinct().orderBy(type_col).collect():  # one per class
            self.catalog.define_class(local_name(t))
            mine = rows.where(F.col(type_col) == t).drop(type_col)
            self._append(f"nodes/{local_name(t)}", _without_empty(mine, self.store.get(f"nodes/{local_name(t)}")))
        self.commit()
        return n

    def insert_edge_table(self, data, type_col: str = "type", src: str = "src", dst: str = "dst") -> int:  # noqa: ANN001
        """Edges between external ids; an unknown or missing id is an error, and then nothing is inserted."""
        df = self._batch(data, type_col, src, dst)
        rows = self._with_ends(df, src, dst)
        n, lost = rows.agg(F.count("*"), F.min(F.when(F.col("s_").isNull() | F.col("d_").isNull(), F.struct(src, dst)))).first()
        if lost is not None:
            raise GraphError(7021, f"unknown node in edge {tuple(lost)}")
        self.lsn += 1
        rows = rows.drop(src, dst).withColumnsRenamed({"s_": "src", "d_": "dst"})
        for (t,) in rows.select(type_col).distinct().orderBy(type_col).collect():
            self._add_edges(local_name(t), rows.where(F.col(type_col) == t).drop(type_col))
        self.commit()
        return n

    def _with_ends(self, df: DataFrame, src: str, dst: str) -> DataFrame:
        known = self._known(df, src, dst)
        named = lambda end, out: known.select(F.col("node_id").alias(end), F.col("gid").alias(out))
        return keep(df.join(named(src, "s_"), src, "left").join(named(dst, "d_"), dst, "left"))

    def _add_edges(self, name: str, rows: DataFrame) -> None:
        """Appends edges; their ids go on from the last one, in order of `_row`."""
        self.catalog.define_property(name)
        keyed = keep(rows)
        n, top = keyed.count(), self.next_eid.get(name, 0)
        if n <= IN_KEYS:
            order = {r[0]: top + i for i, r in enumerate(sorted(keyed.select("_row").collect()))}
            eids = self.spark.createDataFrame(list(order.items()), "_row bigint, eid bigint")
            keyed = keyed.join(eids, "_row").drop("_row")
        else:
            keyed = running_before(keyed.withColumn("one_", F.lit(1)), [], F.shiftright("_row", 33), [F.col("_row")], {"n_": ("sum", "one_")})
            keyed = keyed.withColumn("eid", F.coalesce("n_", F.lit(0)) + top).drop("_row", "one_", "n_")
        self.next_eid[name] = top + n
        self._append(f"edges/{name}", _without_empty(keyed, self.store.get(f"edges/{name}")))

    def upsert_node_table(self, data, key: str = "node_id", type_col: str = "type", update_existing: bool = True) -> dict[str, int]:  # noqa: ANN001
        """Merge by key: given columns override, others keep their value, and the gid stays.

        Replaced versions are ended, not rewritten, so older snapshots still see them. Of a key repeated in one batch the
        last row counts (a DataFrame's rows are taken in its order), the others count as updates. A key given with
        another class than it has moves there with its values. Rows without key or type count as failed.
        """
        self.lsn += 1
        df = self._batch(data, key, type_col)
        values = [c for c in df.columns if c not in (key, type_col, "_row")]
        ok = F.col(key).isNotNull() & F.col(type_col).isNotNull()
        last = F.max_by(F.struct(F.element_at(F.split(type_col, "[/#:]"), -1).alias("type_"), *values), "_row")
        one = keep(df.where(ok).groupBy(F.col(key).alias("node_id")).agg(last.alias("v"), F.count("*").alias("n_")).select("node_id", "v.*", "n_"))
        known = self._known(one, "node_id")
        j = keep(one.join(known.withColumnRenamed("node_type", "was_"), "node_id", "left"))
        rows, keys, old = j.agg(F.coalesce(F.sum("n_"), F.lit(0)), F.count("*"), F.count("gid")).first()
        again = rows - (keys - old)  # rows for keys that were there, or came earlier in the batch
        counts = {"inserted": keys - old, "updated": again if update_existing else 0, "skipped": 0 if update_existing else again, "failed": df.where(~ok).count()}
        if not update_existing:
            j = j.where("gid is null")
        fresh = self._gids(j.where("gid is null").select(F.col("node_id").alias("key_"))).withColumnsRenamed({"gid": "new_"})
        batch = keep(j.join(fresh, F.col("node_id") == F.col("key_"), "left").withColumn("gid", F.coalesce("gid", "new_")).drop("key_", "new_", "n_"))
        for r in batch.groupBy("type_").agg(F.collect_set("was_").alias("was")).orderBy("type_").collect():  # one per class
            self.catalog.define_class(r["type_"])
            mine = batch.where(F.col("type_") == r["type_"]).drop("type_", "was_")
            self._merge(f"nodes/{r['type_']}", mine, "gid", [f"nodes/{w}" for w in r["was"]])
        self.commit()
        return counts

    def _merge(self, name: str, batch: DataFrame, key: str, was: list[str]) -> None:
        """Ends the live rows of `batch`'s keys in the tables `was`, and appends them to `name` with the batch's values."""
        ids = few(batch, key)
        live = []
        for t in was:
            rows = self.store.get(t).where(F.col(DELETED).isNull())
            rows = rows.join(batch.select(key), key, "left_semi") if ids is None else rows.where(among(key, ids))
            live.append((t, keep(rows)))
        new = batch
        if live:
            old = union_all([df.drop(DELETED) for _, df in live])
            # Of several live rows of a key the last one counts.
            old = old.groupBy(key).agg(F.max_by(F.struct(*[c for c in old.columns if c not in (key, CREATED)]), CREATED).alias("w_"))
            kept = [c for c in old.schema["w_"].dataType.names if c not in batch.columns]
            new = batch.join(old, key, "left").select(*batch.columns, *[F.col(f"w_.{c}").alias(c) for c in kept])
        new = keep(new)
        for t, df in live:
            self.store.end(t, df, self.lsn)
        self._append(name, _without_empty(new, self.store.get(name)))

    def upsert_edge_table(self, data, type_col: str = "type", src: str = "src", dst: str = "dst") -> dict[str, int]:  # noqa: ANN001
        """Merge of edges by type, source, target, and index_name and metric where given. The last of repeated rows counts;
        rows without type or with an unknown end count as failed."""
        self.lsn += 1
        df = self._batch(data, type_col, src, dst)
        keys = ["src", "dst", *[c for c in ("index_name", "metric") if c in df.columns]]
        rows = self._with_ends(df, src, dst).drop(src, dst).withColumnsRenamed({"s_": "src", "d_": "dst"})
        ok = F.col(type_col).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
        total = {"inserted": 0, "updated": 0, "skipped": 0, "failed": rows.where(~ok).count()}
        rows = rows.where(ok)
        for (t,) in rows.select(type_col).distinct().orderBy(type_col).collect():
            name = local_name(t)
            mine = rows.where(F.col(type_col) == t).drop(type_col)
            values = [c for c in mine.columns if c not in keys]
            one = keep(mine.groupBy(*keys).agg(F.max_by(F.struct(*values), "_row").alias("v"), F.count("*").alias("n_")).select(*keys, "v.*", "n_"))
            old = self.store.get(f"edges/{name}")
            if old is None:
                hit = one.withColumn("eid", F.lit(None).cast("long"))
            else:
                shared = [k for k in keys if k in old.columns]
                same = reduce(lambda a, b: a & b, [one[k].eqNullSafe(F.col(f"{k}_was")) for k in shared])
                hit = one.join(old.where(F.col(DELETED).isNull()).select(*[F.col(k).alias(f"{k}_was") for k in shared], "eid"), same, "left").drop(*[f"{k}_was" for k in shared])
            hit = keep(hit)
            n, size, known = hit.agg(F.coalesce(F.sum("n_"), F.lit(0)), F.count("*"), F.count("eid")).first()
            total["inserted"] += size - known
            total["updated"] += n - (size - known)
            if known:
                self._merge(f"edges/{name}", hit.where("eid is not null").drop("n_", "_row"), "eid", [f"edges/{name}"])
            if size > known:
                self._add_edges(name, hit.where("eid is null").drop("n_", "eid"))
        self.commit()
        return total

    def delete_nodes(self, cls: str, gids: DataFrame) -> int:
        """Ends the live rows of a class with these `gid`s, and the edges from and to them."""
        self.lsn += 1
        gids, n = keep(gids.select("gid").distinct()), 0
        for name in [f"nodes/{self.catalog.find(cls).name}", *[t for t in self.store.names() if t.startswith("edges/")]]:
            live = self.store.get(name).where(F.col(DELETED).isNull())
            if name.startswith("nodes/"):
                gone = live.join(gids, "gid", "left_semi")
            else:
                ends = lambda c: live.join(gids, F.col(c) == gids["gid"], "left_semi").select("eid", CREATED)  # noqa: B023, E731
                gone = ends("src").union(ends("dst")).distinct()
            gone = keep(gone)
            count = gone.count()
            n += count if name.startswith("nodes/") else 0
            if count:
                self.store.end(name, gone, self.lsn)
        self.commit()
        return n

    def _nodes_of_triples(self, nodes: dict[str, DataFrame]) -> int:
        """Merges nodes; an id that was only referred to (`_placeholder`) is left alone if it is known."""
        known, n = self._index(), 0
        for name, df in nodes.items():
            n += df.count()
            if "_placeholder" in df.columns:
                df = df.where(~F.col("_placeholder")).unionByName(df.where("_placeholder").join(known.select("node_id"), "node_id", "left_anti"))
            self.upsert_node_table(df.withColumn("type", F.lit(name)))
        return n

    def insert_triples(self, triples) -> dict[str, int]:  # noqa: ANN001
        """Triples of strings or numbers (rows or a DataFrame `subject, predicate, object`) as nodes and edges. Of several
        literals of one property the last counts; `replaced` is the number of the others."""
        given = triples if isinstance(triples, DataFrame) else self.frame([{"subject": s, "predicate": p, "object": str(o)} for s, p, o in triples])
        nodes, edges, replaced = ingest.lower_triples(keep(given.withColumn("_row", F.monotonically_increasing_id())), self._index().select("node_id", F.col("node_type").alias("known_")))
        return {"nodes": self._nodes_of_triples(nodes), "edges": self.insert_edge_table(edges) if edges is not None else 0, "replaced": replaced}

    def import_ntriples(self, path: str, default_class: str = "Resource") -> dict[str, int]:
        triples, skipped = ingest.read_ntriples(self.spark, path)
        nodes, edges, replaced = ingest.lower_ntriples(triples, default_class, self._index().select("node_id", F.col("node_type").alias("known_")))
        n = self._nodes_of_triples(nodes)
        return {"nodes": n, "edges": self.insert_edge_table(edges) if edges is not None and not edges.isEmpty() else 0, "skipped": skipped, "replaced": replaced}

    def ingest_nodes_from_parquet(self, cls: str, path: str, column_map: dict[str, str] | None = None, types: dict[str, str] | None = None, max_rejected: int | None = None) -> dict:
        """Loads files into a class; rows with values of the wrong type are set aside. `accepted`, `rejected`, and the
        latter as `quarantine`. More than `max_rejected` of them are an error, and nothing is loaded."""
        good, bad = ingest.nodes_from_parquet(self.spark, path, column_map, types)
        bad = self._rejected(bad, max_rejected)
        self.catalog.define_class(local_name(cls))
        n = self.insert_nodes(cls, good) if "node_id" not in good.columns else self.insert_node_table(good.withColumn("type", F.lit(local_name(cls))))
        return {"accepted": n, "rejected": bad.count(), "quarantine": bad}

    def ingest_edges_from_parquet(self, relation: str, path: str, column_map: dict[str, str] | None = None, types: dict[str, str] | None = None, max_rejected: int | None = None) -> dict:
        """The same for edges whose `src` and `dst` are gids."""
        good, bad = ingest.edges_from_parquet(self.spark, path, column_map, types)
        bad = self._rejected(bad, max_rejected)
        self.lsn += 1
        df = self._batch(good)
        self._add_edges(local_name(relation), df)
        self.commit()
        return {"accepted": df.count(), "rejected": bad.count(), "quarantine": bad}

    @staticmethod
    def _rejected(bad: DataFrame, most: int | None) -> DataFrame:
        bad = keep(bad)
        if most is not None and (n := bad.count()) > most:
            raise GraphError(7032, f"{n} rows rejected, more than {most}")
        return bad

    def import_resources(self, objects: Iterable, policy: str = "merge") -> dict[str, int]:
        """Dicts or triples in the known shapes (see `ingest.shape_of`), in batches by shape: nodes first. With the policy
        `merge` a known node takes the new values, with `skip` it stays as it is, with `error` it is an error."""
        if policy not in ("merge", "skip", "error"):
            raise GraphError(7060, f"unknown policy {policy!r}")
        shaped: dict[str, list] = {"node": [], "edge": [], "triple": []}
        for o in objects:
            kind, data = ingest.shape_of(o)
            shaped[kind].append(data)
        if policy == "error" and shaped["node"]:
            hit = self._index([str(d["node_id"]) for d in shaped["node"]]).limit(1).collect()
            if hit:
                raise GraphError(7061, f"{hit[0]['node_id']!r} exists")
        out = {"nodes": 0, "edges": 0}
        if shaped["node"]:
            counts = self.upsert_node_table(shaped["node"], update_existing=policy != "skip")
            out["nodes"] += counts["inserted"] + counts["updated"]
        if shaped["triple"]:
            counts = self.insert_triples(shaped["triple"])
            out = {k: out[k] + counts[k] for k in out}
        if shaped["edge"]:
            out["edges"] += self.insert_edge_table(shaped["edge"])
        return out

    def import_resource(self, obj, policy: str = "merge") -> dict[str, int]:  # noqa: ANN001
        return self.import_resources([obj], policy)

    # --- reading

    def node_table(self, cls: str, columns: list[str] | None = None) -> DataFrame:
        df = self.graph.nodes(cls)
        return df.select(*columns) if columns else df

    def edge_table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.graph.edges(name)
        return df.select(*columns) if columns else df

    def nodes(self, cls: str) -> NodeQuery:
        return NodeQuery(self.graph.nodes(cls))

    def query_nodes(self, label: str, where: str = "", return_col: str | None = None) -> DataFrame:
        """One predicate `property (= == >= <= > <) value`; empty, `true` and `*` take all."""
        df = self.graph.nodes(label)
        if where.strip() not in ("", "true", "*"):
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(==|>=|<=|=|>|<)\s*(.+?)\s*", where)
            if not m or m[1] not in df.columns:
                raise GraphError(6020, f"can't read predicate {where!r}")
            kind = dict(df.dtypes)[m[1]]
            value = F.lit(m[3].strip("'\"")).cast(kind)
            c = F.col(m[1])
            df = df.where({"=": c == value, "==": c == value, ">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value}[m[2]])
        return df.select(return_col) if return_col else df

    def resource(self, external_id: str) -> ResourceRef:
        got = self._index().where(F.col("node_id") == external_id).limit(1).collect()
        if not got:
            raise GraphError(7012, f"no resource {external_id!r}")
        r = got[0]
        return ResourceRef(external_id, r["gid"], r["node_type"], self.catalog.classes[r["node_type"]].iri)

    def sql(self, script: str, params: dict | None = None) -> Result:
        return Result(compile_query(self.graph, script, params, self._vector_indexes()))

    def _only_query(self, script: str) -> Query:
        return next(s for s in parse(script) if isinstance(s, Query))

    def explain(self, script: str) -> dict:
        """The physical plan of a query. A variable-length pattern is searched while its plan is made."""
        return self.explain_query(self._only_query(script))

    def explain_query(self, q: Query) -> dict:
        df = Compiler(self.graph, None, self._vector_indexes()).run(q)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        used = [c.args[0][1] for c in q.clauses if c.kind == "call" and c.args and c.args[0][0] == "lit"]
        return {"plan": plan, "columns": df.columns, "clauses": [c.kind for c in q.clauses], "indexes_used": used}

    def explain_logical(self, script: str, optimized: bool = True) -> list[dict]:
        """The operators of a query's logical plan, from the top."""
        return observability.logical_plan(self.sql(script).df, optimized)

    def profile_query(self, q: Query) -> dict:
        with self.tracer.span("query", clauses=[c.kind for c in q.clauses]):
            with self.tracer.span("plan"):
                df = Compiler(self.graph, None, self._vector_indexes()).run(q)
            with self.tracer.span("run"):
                return observability.profile(df)

    def profile(self, script: str) -> dict:
        """Runs a query: `rows`, `seconds`, and the operators that ran with their rows and metrics."""
        return self.profile_query(self._only_query(script))

    @staticmethod
    def capabilities() -> dict:
        return {"language": ["MATCH", "OPTIONAL MATCH", "WHERE", "WITH", "UNWIND", "CALL", "RETURN", "AS_OF", "UNION", "SET", "DELETE", "MERGE", "BEGIN", "EXPORT"], "vector_metrics": sorted(vector.METRICS), "path_scores": list(traverse.SCORES), "engine": "spark"}

    # --- indexes: stored tables, built when they are first used and again after their class has changed

    def _define_index(self, d: IndexDef) -> IndexDef:
        old = self.catalog.indexes.get(d.name)
        if old is not None and old != d:
            raise GraphError(7090, f"index {d.name!r} exists with another definition")
        self.catalog.indexes[d.name] = d
        self.commit()
        return d

    def _index_def(self, name: str, kind: str) -> IndexDef:
        i = self.catalog.indexes.get(name)
        if i is None or i.kind != kind:
            raise GraphError(7090, f"no {kind} index {name!r}")
        return i

    def built(self, name: str) -> dict | vector.InvertedFile:
        """The stored form of an index over the class as it is now."""
        i = self.catalog.indexes.get(name)
        if i is None:
            raise GraphError(7090, f"no index {name!r}")
        state = json.dumps(self.store.files.get(f"nodes/{self.catalog.find(i.node_type).name}"))
        have = self._built.get(name)
        if have is None or have[0] != state:
            nodes, folder = self.graph.nodes(i.node_type), f"{self.store.folder}/indexes/{name}-{uuid.uuid4().hex}"
            if i.kind == "text":
                made = indexes.build_text(nodes, i.columns, folder)
            elif i.kind == "property":
                made = indexes.build_property(nodes, i.columns[0], folder)
            else:
                made = vector.InvertedFile(nodes, "gid", i.columns[0], folder=folder)
            have = self._built[name] = (state, made)
        return have[1]

    def is_stale(self, name: str) -> bool:
        """Whether an index has to be built (again) before it is used."""
        i = self.catalog.indexes[name]
        have = self._built.get(name)
        return have is None or have[0] != json.dumps(self.store.files.get(f"nodes/{self.catalog.find(i.node_type).name}"))

    def create_property_index(self, name: str, node_type: str, column: str) -> IndexDef:
        return self._define_index(IndexDef(name, "property", node_type, [column]))

    def create_vector_index(self, name: str, node_type: str, column: str, dim: int, metric: str = "cosine", allow_null_vectors: bool = False) -> IndexDef:
        vector.distance(metric, F.array(), F.array())
        rows = self.graph.nodes(node_type)
        wrong = rows.where(F.size(column) != dim if allow_null_vectors else F.coalesce(F.size(column) != dim, F.lit(True))).limit(1).count()
        if wrong:
            raise GraphError(7091, f"{node_type}.{column} has vectors without {dim} numbers")
        return self._define_index(IndexDef(name, "vector", node_type, [column], {"dim": dim, "metric": metric}))

    def rebuild_vector_index(self, name: str) -> None:
        self._index_def(name, "vector")
        self._built.pop(name, None)
        self.built(name)

    def create_text_index(self, name: str, node_type: str, columns: list[str]) -> IndexDef:
        return self._define_index(IndexDef(name, "text", node_type, columns))

    def drop_index(self, name: str) -> None:
        if self.catalog.indexes.pop(name, None) is None:
            raise GraphError(7090, f"no index {name!r}")
        self._built.pop(name, None)
        self.commit()

    def list_indexes(self, kind: str | None = None) -> list[IndexDef]:
        return [i for i in self.catalog.indexes.values() if kind in (None, i.kind)]

    def _vector_indexes(self) -> dict:
        return {i.name: (i.node_type, i.columns[0], i.options["metric"]) for i in self.list_indexes("vector")}

    def property_lookup(self, name: str, value) -> DataFrame:  # noqa: ANN001
        """The nodes with a value (None: without one), found by the index."""
        i = self._index_def(name, "property")
        hits = indexes.property_gids(self.spark, self.built(name), value)
        gids = few(hits, "gid")
        nodes = self.graph.nodes(i.node_type)
        return nodes.join(hits, "gid", "left_semi") if gids is None else nodes.where(among("gid", gids))

    def text_search(self, index: str, query: str, top_k: int = 10) -> DataFrame:
        return text.text_search(self.text_hits(index, query), query, top_k)

    def vector_search(self, index: str, query: list[float], top_k: int = 10, filters: dict | None = None, boosts: list[dict] | None = None, probes: int | None = None, return_properties: Iterable[str] | None = None) -> DataFrame:
        """The nearest nodes: by a scan, which is exact, or with `probes` (cosine only) in so many lists of the index.
        Entities of boosts are external ids or gids."""
        rows, column, q = self._vectors(index, query)
        i = self._index_def(index, "vector")
        for b in boosts or []:
            if "entities" in b:
                b["entities"] = [r["gid"] for r in self._refs(b["entities"]).collect()]
        if probes is not None:
            if i.options["metric"] != "cosine":
                raise GraphError(6062, "lists are by cosine")
            rows = self.built(index).near(q, probes)
        return self._with_properties(vector.vector_search(rows, column, q, top_k, i.options["metric"], filters, boosts, lambda gids: self.graph.adjacency(None, "both", only=gids, properties=False)), "gid", return_properties)

    # --- versions, inference, exchange

    def create_snapshot(self, name: str) -> int:
        self.graph.create_snapshot(name, self.lsn)
        self.snapshots = self.graph.snapshots
        self.commit()
        return self.lsn

    def list_snapshots(self) -> dict[str, int]:
        return dict(self.snapshots)

    def release_snapshot(self, name: str) -> None:
        self.graph.release_snapshot(name)
        self.snapshots = self.graph.snapshots
        self.commit()

    def at(self, snapshot: str | int) -> PropertyGraph:
        return self.graph.at(snapshot)

    def infer_closure(self, names: list[str]) -> dict:
        """Adds the edges that the characteristics of properties imply, as new versions of their own."""
        self.lsn += 1
        g, report = ontology.infer_closure(self.graph, names)
        for n in names:
            if report[n]["added"]:
                new = g.stored_edges[n].where(F.col(CREATED).isNull() & F.coalesce("_inferred", F.lit(False))).drop(CREATED, DELETED, "eid")
                self._add_edges(n, new.withColumn("_row", F.monotonically_increasing_id()))
        self.commit()
        return report


def _without_empty(df: DataFrame, like: DataFrame | None) -> DataFrame:
    """`df` without columns that are null throughout and that the table it goes to doesn't have; of the table's types where
    a column of nulls has another one."""
    have = {} if like is None else dict(like.dtypes)
    doubtful = [c for c, t in df.dtypes if (like is not None and c not in have) or have.get(c, t) != t]
    empty = df.agg(*[F.count(c).alias(c) for c in doubtful]).first() if doubtful else ()
    nulls = {c for c, n in zip(doubtful, empty, strict=True) if not n}
    return df.drop(*[c for c in nulls if c not in have]).withColumns({c: F.lit(None).cast(have[c]) for c in nulls if c in have})
