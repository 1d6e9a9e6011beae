"""Sinks: a subgraph as Parquet or Arrow, a resource as Turtle, a database folder as one file; and graph differences."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafloom.errors import GraphError
from grafloom.graph import CREATED, DELETED, PropertyGraph, union_all


def export_parquet(g: PropertyGraph, folder: str, classes: list[str] | None = None, relations: list[str] | None = None) -> list[str]:
    """Writes `nodes/<class>` and `edges/<relation>` below `folder`; returns these names."""
    out = []
    for n in classes if classes is not None else list(g.stored_nodes):
        g.nodes(n).write.mode("overwrite").parquet(f"{folder}/nodes/{n}")
        out.append(f"nodes/{n}")
    for n in relations if relations is not None else list(g.stored_edges):
        g.edges(n).write.mode("overwrite").parquet(f"{folder}/edges/{n}")
        out.append(f"edges/{n}")
    if not out:
        raise GraphError(6160, "nothing to export")
    return out


def export_arrow(tables: dict[str, DataFrame], path: str) -> None:
    """A small subgraph as one Arrow IPC file of rows `(key, payload)`; for data that fits in the driver."""
    import pyarrow as pa

    if not tables:
        raise GraphError(6160, "nothing to export")
    keys, payloads = [], []
    for key, df in tables.items():
        t, sink = df.toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        keys.append(key)
        payloads.append(sink.getvalue().to_pybytes())
    whole = pa.table({"key": keys, "payload": pa.array(payloads, pa.binary())})
    with pa.ipc.new_file(path, whole.schema) as w:
        w.write_table(whole)


def import_arrow(spark, path: str) -> dict[str, DataFrame]:  # noqa: ANN001
    import pyarrow as pa

    whole = pa.ipc.open_file(path).read_all()
    return {k: spark.createDataFrame(pa.ipc.open_stream(v).read_all()) for k, v in zip(whole["key"].to_pylist(), whole["payload"].to_pylist(), strict=True)}


def turtle(g: PropertyGraph, external_id: str, base: str = "urn:local:") -> str:
    """One node as Turtle: class, literals that are not null, outgoing edges."""
    hit = g.node_index().where(F.col("node_id") == external_id).limit(1).collect()
    if not hit:
        raise GraphError(7012, f"no resource {external_id!r}")
    gid, kind = hit[0]["gid"], hit[0]["node_type"]
    row = g.nodes(kind).where(F.col("gid") == gid).first().asDict()
    iri = lambda x: f"<{x}>" if "://" in str(x) or str(x).startswith("urn:") else f"<{base}{x}>"
    quote = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    lines = [f"{iri(external_id)} a {iri(kind)}"]
    lines += [f"  {iri(k)} {quote(v)}" for k, v in sorted(row.items()) if v is not None and k not in ("gid", "node_id", CREATED, DELETED)]
    steps = g.adjacency(None, "out").where(F.col("node") == gid).join(g.node_index().select(F.col("gid").alias("next"), F.col("node_id").alias("to")), "next")
    lines += [f"  {iri(r['edge_type'])} {iri(r['to'])}" for r in steps.orderBy("edge_type", "eid").collect()]
    return " ;\n".join(lines) + " .\n"


def pack(folder: str, path: str) -> int:
    """A database folder as one ZIP file; the number of files in it."""
    files = [p for p in sorted(Path(folder).rglob("*")) if p.is_file()]
    with zipfile.ZipFile(path, "w") as z:
        for p in files:
            z.write(p, p.relative_to(folder))
    return len(files)


def is_packed(path: str) -> bool:
    return Path(path).is_file() and zipfile.is_zipfile(path)


def unpack(path: str, folder: str) -> None:
    root = Path(folder).resolve()
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            if not (root / n).resolve().is_relative_to(root):
                raise GraphError(7001, f"{n} leads out of the folder")
        z.extractall(root)


def diff(a: PropertyGraph, b: PropertyGraph) -> DataFrame:
    """`kind`, `name`, `only_a`, `only_b`, `both`, `schema_changed`: per class distinct ids, per relation distinct ends."""
    parts = []
    for kind, left, right, keys in (("class", a.stored_nodes, b.stored_nodes, ["id"]), ("relation", a.stored_edges, b.stored_edges, ["src", "dst"])):
        for name in sorted({*left, *right}):
            frames, kinds = [], []
            for g, have, flag in ((a, left, "in_a"), (b, right, "in_b")):
                if name in have:
                    df = g.nodes(name) if kind == "class" else g.edges(name)
                    kinds.append(sorted(df.dtypes))
                    if kind == "class":
                        df = df.select(F.coalesce(F.col("node_id").cast("string"), F.col("gid").cast("string")).alias("id") if "node_id" in df.columns else F.col("gid").cast("string").alias("id"))
                    frames.append(df.select(*keys).distinct().withColumn(flag, F.lit(1)))
            both = union_all(frames)
            for flag in ("in_a", "in_b"):
                if flag not in both.columns:
                    both = both.withColumn(flag, F.lit(None).cast("int"))
            per = both.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
            count = lambda c: F.count(F.when(c, 1))
            parts.append(
                per.agg(count(F.col("in_b").isNull()).alias("only_a"), count(F.col("in_a").isNull()).alias("only_b"), count(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"))
                .select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "only_a", "only_b", "both", F.lit(len(kinds) == 2 and kinds[0] != kinds[1]).alias("schema_changed"))
            )
    return union_all(parts)
