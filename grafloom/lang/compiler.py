"""Syntax tree to DataFrames. Patterns become equality joins that Catalyst may reorder, prune and push filters into."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.catalog import local_name
from grafloom.errors import GraphError
from grafloom.functions import builtins as fn
from grafloom.graph import CREATED, DELETED, PropertyGraph, union_all, visible
from grafloom.lang.parser import Clause, Node, Pattern, Query, Rel, parse
from grafloom.operators import traverse, vector

_TYPES = {"INT": "bigint", "INT64": "bigint", "INT32": "int", "INT16": "smallint", "INT8": "tinyint", "F32": "float", "F64": "double", "STRING": "string", "BOOL": "boolean", "DATE": "date", "DATETIME": "timestamp", "BYTES": "binary"}


@dataclass
class _Factor:
    """One of several patterns of a MATCH for itself: its rows, its aliases and the columns it has in common with others."""

    rows: DataFrame
    aliases: set[str]
    shared: set[str]


class Compiler:
    """One query over one graph. Columns of an alias `a` are named `a.x`; values have their own name."""

    def __init__(self, graph: PropertyGraph, params: dict | None = None, vector_indexes: dict | None = None) -> None:
        self.g, self.params, self.vectors = graph, params or {}, vector_indexes or {}
        self.df: DataFrame | None = None
        self.labels: dict[str, list[str]] = {}  # node aliases
        self.edges: set[str] = set()
        self.paths: set[str] = set()
        self.names = 0
        self.alone: tuple | None = None  # patterns, graph and WHERE of a first MATCH of several patterns, till another clause
        self.distinct: dict[str, Column] = {}  # arguments of aggregates over distinct values, columns while they are computed

    # --- clauses

    def run(self, q: Query) -> DataFrame:
        out = self._single(q)
        for op, whole, other in q.more:
            part = Compiler(self.g, self.params, self.vectors)._single(other)
            if len(part.columns) != len(out.columns):
                raise GraphError(6020, f"{op} of {len(out.columns)} and {len(part.columns)} columns")
            part = part.toDF(*out.columns)
            if op == "UNION":
                out = out.unionAll(part) if whole else out.unionAll(part).distinct()
            else:
                out = {("INTERSECT", False): out.intersect, ("INTERSECT", True): out.intersectAll, ("EXCEPT", False): out.subtract, ("EXCEPT", True): out.exceptAll}[op, whole](part)
        return out

    def _single(self, q: Query) -> DataFrame:
        self.body(q)
        if q.clauses[-1].kind != "return":
            raise GraphError(6020, "a query ends with RETURN")
        return self._project(q.clauses[-1], q)

    def body(self, q: Query) -> None:
        """The clauses before RETURN; the rows are in `df`."""
        clauses = list(q.clauses)
        for i, c in enumerate(clauses):
            if c.kind == "match":
                g = self.g.at(c.as_of) if c.as_of else self.g
                where = clauses[i + 1] if i + 1 < len(clauses) and clauses[i + 1].kind == "where" else None
                self._match(c, g, where)
                self.alone = (c.patterns, g, where) if i == 0 and not c.optional and len(c.patterns) > 1 else None
            elif c.kind == "where":
                if i and clauses[i - 1].kind == "match":
                    continue
                self.df = self._with_degrees([c.expr], self.df).where(self.expr(c.expr))
            elif c.kind == "unwind":
                base = self.df if self.df is not None else self.g.spark.range(1).select()
                self.df = base.select("*", F.explode(self.expr(c.expr)).alias(c.name))
            elif c.kind == "call":
                self._call(c)
            elif c.kind == "with":
                self._project(c, Query([]), keep=True)
            if c.kind not in ("match", "return"):
                self.alone = None

    def _match(self, c: Clause, g: PropertyGraph, where: Clause | None) -> None:
        self._subclasses = _subclass_terms(where.expr) if where else {}
        before, known = self.df, dict(self.labels)
        if c.optional and before is not None:
            shared = None
            self.df, self.labels = None, {}
            keep_edges, keep_paths = set(self.edges), set(self.paths)
            for p in c.patterns:
                self._pattern(p, g)
            found = self.df
            shared = [a for a in self.labels if a in known]
            if where is not None:
                found = self._with_degrees([where.expr], found).where(self.expr(where.expr))
            new = [x for x in found.columns if x.split(".")[0] not in known]
            found = found.select(*[F.col(f"`{a}.gid`").alias(f"{a}.gid_o") for a in shared], *[F.col(f"`{x}`") for x in new])
            on = reduce(lambda x, y: x & y, [F.col(f"`{a}.gid`") == F.col(f"`{a}.gid_o`") for a in shared]) if shared else F.lit(True)
            self.df = before.join(found, on, "left").drop(*[f"{a}.gid_o" for a in shared])
            self.labels, self.edges, self.paths = known | self.labels, keep_edges | self.edges, keep_paths | self.paths
            return
        for p in c.patterns:
            self._pattern(p, g)
        if where is not None:
            self.df = self._with_degrees([where.expr], self.df).where(self.expr(where.expr))

    def _call(self, c: Clause) -> None:
        if c.name != "vector.search":
            raise GraphError(6020, f"unknown procedure {c.name}")
        args = [self._constant(a) for a in c.args]
        name, q, k, *more = args
        if name not in self.vectors:
            raise GraphError(7090, f"no vector index {name!r}")
        node_type, column, metric = self.vectors[name]
        hits = vector.vector_search(self.g.nodes(node_type), column, q, k, metric, more[0] if more else None)
        wanted = [n[1][0] for n, _ in c.items] or hits.columns
        self.df = hits.select(*wanted)

    def _constant(self, e: tuple):  # noqa: ANN202
        if e[0] == "lit":
            return e[1]
        if e[0] == "list":
            return [self._constant(x) for x in e[1]]
        if e[0] == "map":
            return {k: self._constant(v) for k, v in e[1].items()}
        if e[0] == "param":
            return self._param(e[1])
        raise GraphError(6020, "expected a constant")

    def _param(self, name: str):  # noqa: ANN202
        if name not in self.params:
            raise GraphError(6020, f"no parameter {name}")
        return self.params[name]

    # --- patterns

    def _alias(self, given: str | None) -> str:
        self.names += 1
        return given or f"_{self.names}"

    def _scan(self, n: Node, alias: str, g: PropertyGraph) -> DataFrame:
        if n.labels:
            names = [g.catalog.find(_expand(x, g)).name for x in n.labels]
            base = self._subclasses.get(alias)
            if base is not None:
                # The condition is on the label: below the base, the label's whole closure is scanned; else nothing.
                rows = g.closure(names[0])
                rows = rows if g.catalog.is_a(names[0], _expand(base, g)) else rows.where(F.lit(False))
            else:
                rows = g.nodes(names[0])
            for other in names[1:]:
                rows = rows.join(g.nodes(other).select("gid"), "gid", "left_semi")
        else:
            names = list(g.stored_nodes)
            rows = _any_nodes(g)
        self.labels[alias] = names
        for k, v in n.props.items():
            rows = rows.where(F.lit(False) if k not in rows.columns else F.col(k) == self.expr(v))
        return rows.select(*[F.col(c).alias(f"{alias}.{c}") for c in rows.columns if c not in (CREATED, DELETED)])

    def _node(self, n: Node, alias: str, g: PropertyGraph, on: str | None) -> None:
        """Joins a node to column `on`, or starts with it; a known alias is an equality."""
        if alias in self.labels and self.df is not None and f"{alias}.gid" in self.df.columns:
            if on is not None:
                self.df = self.df.where(F.col(f"`{on}`") == F.col(f"`{alias}.gid`"))
            if n.labels or n.props:
                again = self._scan(Node(None, n.labels, n.props), f"{alias}_x", g)
                self.labels.pop(f"{alias}_x", None)
                self.df = self.df.join(again.select(F.col(f"`{alias}_x.gid`")), F.col(f"`{alias}.gid`") == F.col(f"`{alias}_x.gid`"), "left_semi")
            return
        rows = self._scan(n, alias, g)
        if on is not None:
            self.df = self.df.join(rows, F.col(f"`{on}`") == F.col(f"`{alias}.gid`"))
        else:
            self.df = rows if self.df is None else self.df.crossJoin(rows)

    def _pattern(self, p: Pattern, g: PropertyGraph) -> None:
        if self.df is not None:
            known = [n.alias in self.labels for n in p.nodes]
            if known[-1] and not known[0] and p.path is None and not any(r.hops for r in p.rels):
                # From the node that is known, so that each join has a key.
                turned = [Rel(r.alias, r.types, {"out": "in", "in": "out"}.get(r.direction, r.direction), None, r.props) for r in reversed(p.rels)]
                p = Pattern(None, p.nodes[::-1], turned)
            elif not any(known):
                warnings.warn("a pattern shares no name with those before it: all pairs of their rows", stacklevel=2)
        aliases = [self._alias(n.alias) for n in p.nodes]
        self._node(p.nodes[0], aliases[0], g, None)
        eids = []
        for rel, a, b, node in zip(p.rels, aliases, aliases[1:], p.nodes[1:], strict=False):
            r = self._alias(rel.alias)
            steps = self._variable(rel, r, a, g, node, p.path) if rel.hops else self._steps(rel, r, g)
            self.df = self.df.join(steps, F.col(f"`{a}.gid`") == F.col(f"`{r}.from_`"))
            self._node(node, b, g, f"{r}.to_")
            self.df = self.df.drop(f"{r}.from_", f"{r}.to_")
            if rel.hops is None:
                self.edges.add(r)
                eids.append(f"{r}.eid")
        if p.path and not any(r.hops for r in p.rels):
            self.df = self.df.withColumns({f"{p.path}.depth": F.lit(len(p.rels)), f"{p.path}.nodes": F.array(*[F.col(f"`{a}.gid`") for a in aliases]), f"{p.path}.eids": F.array(*[F.col(f"`{e}`") for e in eids]) if eids else F.array().cast("array<bigint>")})
            self.paths.add(p.path)

    def _relations(self, rel: Rel, g: PropertyGraph) -> list[str]:
        names = [local_name(_expand(t, g)) for t in rel.types] or list(g.stored_edges)
        for n in names:
            g.edges(n)
        return names

    def _steps(self, rel: Rel, r: str, g: PropertyGraph) -> DataFrame:
        parts = []
        for name in self._relations(rel, g):
            e = g.edges(name)
            for k, v in rel.props.items():
                e = e.where(F.col(k) == self.expr(v) if k in e.columns else F.lit(False))
            cols = [F.col(c).alias(f"{r}.{c}") for c in e.columns if c not in (CREATED, DELETED)] + [F.lit(name).alias(f"{r}.type")]
            for a, b in {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[rel.direction]:
                parts.append(e.select(F.col(a).alias(f"{r}.from_"), F.col(b).alias(f"{r}.to_"), *cols))
        return union_all(parts)

    def _variable(self, rel: Rel, r: str, a: str, g: PropertyGraph, node: Node, path: str | None) -> DataFrame:
        low, high = rel.hops
        filters = {k: self._constant(v) for k, v in rel.props.items()}
        adj = traverse.steps_of(g, self._relations(rel, g), rel.direction, filters)
        sources = self.df.select(F.col(f"`{a}.gid`").alias("gid")).distinct().withColumn("pos", F.col("gid"))
        keep = dict(self.labels)
        targets = self._scan(Node(None, node.labels, node.props), "t_", g).select(F.col("`t_.gid`").alias("gid")) if node.labels else None
        self.labels = keep
        found = traverse.simple_paths(adj, sources, targets, high, max(1, low))
        prefix = path or r
        self.paths.add(prefix)
        return found.select(F.col("seed").alias(f"{r}.from_"), F.col("at").alias(f"{r}.to_"), F.col("depth").alias(f"{prefix}.depth"), F.col("nodes").alias(f"{prefix}.nodes"), F.col("eids").alias(f"{prefix}.eids"), F.col("types").alias(f"{prefix}.types"))

    # --- projections

    def _project(self, c: Clause, q: Query, keep: bool = False) -> DataFrame:
        exprs = [e for e, _ in c.items]
        df = self._with_degrees(exprs, self.df)
        names, columns, kept, distinct = [], [], {}, []
        for e, given in c.items:
            if keep and e[0] == "name" and len(e[1]) == 1 and e[1][0] in self.labels | dict.fromkeys(self.edges | self.paths):
                a = given or e[1][0]
                kept[a] = e[1][0]
                continue
            names.append(given or _name(e))
            before = len(self.distinct)
            columns.append((e, self.expr(e)))
            distinct.append(list(self.distinct.items())[before:])
        aggregates = [_has_aggregate(e) for e, _ in columns]
        carried = [(f"{new}.{x.partition('.')[2]}", F.col(f"`{x}`")) for new, old in kept.items() for x in df.columns if x.partition(".")[0] == old]
        order = [(self._order(e, names), d) for e, d in q.order]
        self.distinct = {}
        if any(aggregates):
            keys = {f"k{i}": col for i, ((_, col), agg) in enumerate(zip(columns, aggregates, strict=True)) if not agg} | dict(carried)
            values = {f"k{i}": (e, col, distinct[i]) for i, ((e, col), agg) in enumerate(zip(columns, aggregates, strict=True)) if agg}
            out = self._apart(keys, [e for (e, _), agg in zip(columns, aggregates, strict=True) if not agg], values, set(kept.values()))
            out = _grouped(df, keys, values) if out is None else out
            out = out.select(*[F.col(f"k{i}") for i in range(len(columns))], *[F.col(f"`{n}`") for n, _ in carried])
        else:
            out = df.select(*[col.alias(f"k{i}") for i, (_, col) in enumerate(columns)], *[col.alias(n) for n, col in carried])
        if c.distinct:
            out = out.distinct()
        if keep:
            self.df = out.toDF(*names, *[n for n, _ in carried])
            self.labels = {new: self.labels[old] for new, old in kept.items() if old in self.labels}
            self.edges = {new for new, old in kept.items() if old in self.edges}
            self.paths = {new for new, old in kept.items() if old in self.paths}
            return self.df
        if order:
            by = [F.col(f"k{i}").desc_nulls_last() if d else F.col(f"k{i}").asc_nulls_last() for i, d in order]
            # Equal keys fall back on all columns, so that a limit always keeps the same rows.
            out = out.orderBy(*by, *[F.col(x) for x, t in out.dtypes if not t.startswith(("map", "variant"))])
        if q.skip:
            out = out.offset(q.skip)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.toDF(*names)

    def _factors(self, exprs: list[tuple], kept: set[str]) -> list[_Factor] | None:
        """The patterns of the MATCH, each with the terms of WHERE on its aliases. Their rows, joined on `shared` (the nodes
        in several of them, with all that `exprs`, WHERE or a whole alias in `kept` takes from these), are those of the MATCH.
        None if there is a path, or what takes two patterns together."""
        patterns, g, where = self.alone
        terms = _conjuncts(where.expr) if where else []
        used = [_names(e) for e in [*exprs, *terms]]
        if None in used or any(p.path or any(r.hops for r in p.rels) for p in patterns):
            return None
        first, single, turned = {}, [], []
        for p in patterns:
            here, nodes = set(), []
            for n in p.nodes:
                again = n.alias in first and n.alias not in here
                if again and (n.labels or n.props):
                    return None
                nodes.append(first[n.alias] if again else n)
                here.add(n.alias)
            first |= {n.alias: n for n in reversed(p.nodes) if n.alias and n.alias not in first}
            single += [r.alias for r in p.rels if r.alias]
            turned.append(Pattern(None, nodes, p.rels))
        if len(single) > len(set(single)) or set(single) & set(first):
            return None
        aliases = [{x.alias for x in [*p.nodes, *p.rels] if x.alias} for p in turned]
        common = {a for a in first if sum(a in own for own in aliases) > 1}
        wanted = {f"{n[0]}.{n[1]}" for names in used for n in names if len(n) > 1} | {f"{a}.gid" for a in common}
        out, count = [], self.names
        for p, own in zip(turned, aliases, strict=True):
            part = Compiler(self.g, self.params, self.vectors)
            part._subclasses, part.names = self._subclasses, count
            part._pattern(p, g)
            count = part.names
            for t, names in zip(terms, used[len(exprs) :], strict=True):
                if {n[0] for n in names} <= own:
                    part.df = part.df.where(part.expr(t))
            columns = [x for x in part.df.columns if x.split(".")[0] not in common or x in wanted or x.split(".")[0] in kept]
            shared = {x for x in columns if x.split(".")[0] in common}
            if any("map<" in t or "variant" in t for x, t in part.df.dtypes if x in shared):
                return None
            out.append(_Factor(part.df.select(*[F.col(f"`{x}`") for x in columns]), own, shared))
        if any(not any({n[0] for n in names} <= f.aliases for f in out) for names in used[len(exprs) :]):
            return None
        return out

    def _apart(self, keys: dict[str, Column], key_exprs: list[tuple], values: dict[str, tuple], kept: set[str]) -> DataFrame | None:
        """The groups of a MATCH of several patterns without all pairs of their rows: each aggregate from the patterns it
        needs, reduced to rows that have partners in the others, and then joined by `keys`. None where that isn't the same,
        as repeats count in an aggregate, or where one needs all patterns."""
        if self.alone is None or any(_counts_repeats(e) for e, _, _ in values.values()):
            return None
        factors = self._factors([*key_exprs, *[e for e, _, _ in values.values()]], kept)
        if factors is None:
            return None
        everything = list(range(len(factors)))
        cores: dict[tuple, dict] = {}
        for name, value in values.items():
            needed = {n[0] for e in [*key_exprs, value[0]] for n in _names(e)} | kept
            core = []
            # First those with aliases that no other has; these bring most of the others.
            for a in sorted(needed, key=lambda a: sum(a in f.aliases for f in factors)):
                if not any(a in factors[i].aliases for i in core):
                    core += [i for i in everything if a in factors[i].aliases][:1]
            if not core or len(core) == len(factors) or len(_reached(factors, core[:1], core)) < len(core) or len(_reached(factors, core[:1], everything)) < len(factors):
                return None
            cores.setdefault(tuple(sorted(core)), {})[name] = value
        out = None
        for core, some in cores.items():
            rows = _joined(factors, _reached(factors, core[:1], core))
            rest = [i for i in everything if i not in core]
            while rest:
                group = _reached(factors, rest[:1], rest)
                rest = [i for i in rest if i not in group]
                ends = set.union(*[factors[i].shared for i in core]) & set.union(*[factors[i].shared for i in group])
                others = [_Factor(factors[i].rows.select(*[F.col(f"`{x}`") for x in sorted(factors[i].shared)]).distinct(), set(), factors[i].shared) for i in group]
                rows = _meet(rows, _joined(others, range(len(others))).select(*[F.col(f"`{x}`") for x in sorted(ends)]).distinct(), ends, "left_semi")
            part = _grouped(rows, keys, some)
            out = part if out is None else _meet(out, part, keys, "inner")
        return out

    def _order(self, e: tuple, names: list[str]) -> int:
        for name in (_name(e), ".".join(e[1]) if e[0] == "name" else ""):
            if name in names:
                return names.index(name)
        raise GraphError(6020, "ORDER BY takes returned columns")

    def _with_degrees(self, exprs: list[tuple], df: DataFrame) -> DataFrame:
        """Joins what `degree(a, "rel")` and EXISTS need."""
        for e in exprs:
            for node in _walk(e):
                if node[0] == "call" and node[1] == "degree":
                    a, rel = node[2][0][1][0], node[2][1][1]
                    name = f"degree_{a}_{rel}"
                    if name not in df.columns:
                        d = traverse.degree(self.g, rel).select(F.col("gid").alias(f"{name}_g"), F.col("degree").alias(name))
                        df = df.join(d, F.col(f"`{a}.gid`") == F.col(f"{name}_g"), "left").drop(f"{name}_g").fillna(0, [name])
                elif node[0] == "exists":
                    p: Pattern = node[1]
                    start = p.nodes[0].alias
                    name = f"exists_{id(p)}"
                    if name not in df.columns:
                        inner = Compiler(self.g, self.params)
                        inner._subclasses = {}
                        inner._pattern(p, self.g)
                        hit = inner.df.select(F.col(f"`{start}.gid`").alias(f"{name}_g")).distinct().withColumn(name, F.lit(True))
                        df = df.join(hit, F.col(f"`{start}.gid`") == F.col(f"{name}_g"), "left").drop(f"{name}_g").fillna(False, [name])
        return df

    # --- expressions

    def expr(self, e: tuple) -> Column:
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            return F.lit(self._param(e[1]))
        if kind == "name":
            return self._path(e[1])
        if kind in ("and", "or"):
            a, b = self.expr(e[1]), self.expr(e[2])
            return a & b if kind == "and" else a | b
        if kind == "xor":
            a, b = self.expr(e[1]), self.expr(e[2])
            return (a & ~b) | (~a & b)
        if kind == "not":
            return ~self.expr(e[1])
        if kind == "cmp":
            a, b = self.expr(e[2]), self.expr(e[3])
            return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]
        if kind == "math":
            a, b = self.expr(e[2]), self.expr(e[3])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[e[1]]()
        if kind == "in":
            values = e[2]
            if values[0] == "list":
                return self.expr(e[1]).isin([self._constant(v) for v in values[1]])
            return F.array_contains(self.expr(values), self.expr(e[1]))
        if kind == "null":
            return self.expr(e[1]).isNull()
        if kind == "subclass":
            return F.lit(True)  # decided when the label is scanned
        if kind == "subproperty":
            edge = e[1][2][0] if e[1][0] == "call" and e[1][1] == "type" else e[1]
            if edge[0] != "name" or edge[1][0] not in self.edges:
                raise GraphError(6020, "SUBPROPERTYOF* takes an edge")
            return F.col(f"`{edge[1][0]}.type`").isin(self.g.catalog.subproperties(_expand(e[2], self.g)))
        if kind == "case":
            out = None
            for c, v in e[1]:
                out = F.when(self.expr(c), self.expr(v)) if out is None else out.when(self.expr(c), self.expr(v))
            return out.otherwise(self.expr(e[2]))
        if kind == "list":
            return F.array(*[self.expr(x) for x in e[1]])
        if kind == "map":
            return F.struct(*[self.expr(v).alias(k) for k, v in e[1].items()])
        if kind == "item":
            i = self.expr(e[2])
            return F.try_element_at(self.expr(e[1]), F.when(i < 0, i).otherwise(i + 1).cast("int")) if e[2][0] == "lit" and isinstance(e[2][1], int) else self.expr(e[1])[i]
        if kind == "field":
            return self.expr(e[1])[e[2]]
        if kind == "cast":
            if e[2] not in _TYPES:
                raise GraphError(4001, f"unknown type {e[2]}")
            return self.expr(e[1]).try_cast(_TYPES[e[2]])
        if kind == "exists":
            return F.col(f"exists_{id(e[1])}")
        if kind == "call":
            return self._function(e[1], e[2], e[3])
        raise GraphError(6020, f"unknown expression {kind}")

    def _function(self, name: str, args: list[tuple], distinct: bool) -> Column:
        if name == "degree":
            return F.col(f"`degree_{args[0][1][0]}_{args[1][1]}`")
        if name == "length" and args and args[0][0] == "name" and args[0][1][0] in self.paths and len(args[0][1]) == 1:
            return F.col(f"`{args[0][1][0]}.depth`")
        if name in ("nodes", "relationships") and args[0][0] == "name" and args[0][1][0] in self.paths:
            return F.col(f"`{args[0][1][0]}.{'nodes' if name == 'nodes' else 'eids'}`")
        if name == "type" and args[0][1][0] in self.edges:
            return F.col(f"`{args[0][1][0]}.type`")
        if name == "id":
            return self.expr(args[0])
        if name in fn.AGGREGATES:
            if not args:
                return F.count("*")
            values = [self.expr(a) for a in args]
            if distinct and name not in ("min", "max"):
                if name == "collect":  # null counts as a value, as without DISTINCT
                    return F.transform(F.collect_set(F.struct(values[0].alias("v"))), lambda y: y["v"])
                column = f"distinct_{len(self.distinct)}"
                self.distinct[column] = values[0]
                given = "".join(f", {self._constant(a)}" for a in args[1:])
                return F.expr(f"{fn.DISTINCT.get(name, name)}(distinct {column}{given})")
            return fn.AGGREGATES[name](*values)
        return fn.call(name, [self.expr(a) for a in args])

    def _path(self, parts: list[str]) -> Column:
        head = parts[0]
        columns = self.df.columns if self.df is not None else []
        if head in self.labels and f"{head}.gid" in columns or head in self.edges:
            if len(parts) == 1:
                return F.col(f"`{head}.{'gid' if head in self.labels else 'eid'}`")
            name = f"{head}.{parts[1]}"
            if name not in columns:
                raise GraphError(6020, f"{head} has no {parts[1]}")
            col = F.col(f"`{name}`")
            for p in parts[2:]:
                col = col[p]
            return col
        if head in self.paths and f"{head}.depth" in columns:
            return F.struct(*[F.col(f"`{head}.{x}`").alias(x) for x in ("depth", "nodes", "eids") if f"{head}.{x}" in columns]) if len(parts) == 1 else F.col(f"`{head}.{parts[1]}`")
        if head in columns:
            col = F.col(f"`{head}`")
            for p in parts[1:]:
                col = col[p]
            return col
        raise GraphError(3001, f"unknown name {head}")


def _any_nodes(g: PropertyGraph) -> DataFrame:
    """The nodes of all classes with all their properties, null where a class lacks one; a property whose type differs
    from class to class is text."""
    if g.all_nodes is not None:
        return visible(g.all_nodes, g.lsn)
    types: dict[str, set[str]] = {}
    for df in g.stored_nodes.values():
        for c, t in df.dtypes:
            types.setdefault(c, set()).add(t)
    mixed = {c for c, t in types.items() if len(t) > 1}
    return union_all([g.nodes(n).select(*[F.col(c).cast("string").alias(c) if c in mixed else c for c in df.columns if c != "node_type"], F.lit(n).alias("node_type")) for n, df in g.stored_nodes.items()])


def _expand(ref: str, g: PropertyGraph) -> str:
    prefix, colon, rest = ref.partition(":")
    return g.catalog.prefixes[prefix] + rest if colon and prefix in g.catalog.prefixes else ref


def _name(e: tuple) -> str:
    if e[0] == "name":
        return e[1][-1]
    return e[1] if e[0] == "call" else "expr"


def _walk(e):  # noqa: ANN001, ANN202
    if isinstance(e, tuple):
        if e and isinstance(e[0], str):
            yield e
        for x in e:
            yield from _walk(x)
    elif isinstance(e, list):
        for x in e:
            yield from _walk(x)


def _has_aggregate(e: tuple) -> bool:
    return any(n[0] == "call" and n[1] in fn.AGGREGATES for n in _walk(e))


def _names(e: tuple) -> list[list[str]] | None:
    """The names in an expression; None where it has some that are not seen here."""
    nodes = list(_walk(e))
    if any(n[0] in ("map", "exists") or n[:2] == ("call", "degree") for n in nodes):
        return None
    return [n[1] for n in nodes if n[0] == "name"]


def _conjuncts(e: tuple) -> list[tuple]:
    return [*_conjuncts(e[1]), *_conjuncts(e[2])] if e[0] == "and" else [e]


def _counts_repeats(e: tuple) -> bool:
    """Whether an aggregate in `e` changes if a row is there twice."""
    return any(n[0] == "call" and n[1] in fn.AGGREGATES and not (n[2] and (n[3] or n[1] in ("min", "max"))) for n in _walk(e))


def _grouped(df: DataFrame, keys: dict[str, Column], values: dict[str, tuple]) -> DataFrame:
    """`values`: name to expression, its Column and the columns that this takes distinct values of."""
    distinct = dict(x for _, _, columns in values.values() for x in columns)
    df = df.withColumns(distinct) if distinct else df
    return df.groupBy(*[col.alias(n) for n, col in keys.items()]).agg(*[col.alias(n) for n, (_, col, _) in values.items()])


def _reached(factors: list[_Factor], start: tuple | list, among: tuple | list) -> list[int]:
    """Those of `among` that `start` is joined with, directly or by others of them; each shares a column with one before it."""
    out = list(start)
    for i in out:
        out += [j for j in among if j not in out and factors[i].shared & factors[j].shared]
    return out


def _joined(factors: list[_Factor], order: list[int] | range) -> DataFrame:
    rows, has = None, set()
    for i in order:
        rows = factors[i].rows if rows is None else _meet(rows, factors[i].rows, has & factors[i].shared, "inner")
        has |= factors[i].shared
    return rows


def _meet(left: DataFrame, right: DataFrame, columns, how: str) -> DataFrame:  # noqa: ANN001
    """A join on columns of the same names, which are there once after it; null is equal to null, but for the gids of nodes."""
    if not columns:
        return left.crossJoin(right)
    right = right.select(*[F.col(f"`{x}`").alias(f"{x}_o" if x in columns else x) for x in right.columns])
    pairs = [(F.col(f"`{x}`"), F.col(f"`{x}_o`"), x) for x in sorted(columns)]
    on = reduce(lambda a, b: a & b, [a == b if x.endswith(".gid") else a.eqNullSafe(b) for a, b, x in pairs])
    out = left.join(right, on, how)
    return out if how == "left_semi" else out.drop(*[f"{x}_o" for _, _, x in pairs])


def _subclass_terms(e: tuple) -> dict[str, str]:
    """Alias to base class of the `a.class SUBCLASSOF* C` terms of an AND tree; anywhere else they are an error."""
    if e[0] == "and":
        return _subclass_terms(e[1]) | _subclass_terms(e[2])
    if e[0] == "subclass":
        return {e[1][1][0]: e[2]}
    if any(n[0] == "subclass" for n in _walk(e)):
        raise GraphError(6020, "SUBCLASSOF* stands alone or under AND")
    return {}


def compile_query(graph: PropertyGraph, text: str, params: dict | None = None, vector_indexes: dict | None = None) -> DataFrame:
    """The result of a text with one query, and PREFIX declarations before it."""
    queries = []
    for s in parse(text):
        if isinstance(s, Query):
            queries.append(s)
        elif s.kind == "prefix":
            graph.catalog.prefixes[s.data["name"]] = s.data["iri"]
        else:
            raise GraphError(6020, f"{s.kind} is no query", "use Database.execute")
    if len(queries) != 1:
        raise GraphError(6020, "expected one query")
    return Compiler(graph, params, vector_indexes).run(queries[0])
