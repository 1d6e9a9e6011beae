"""Readers of triples, resources and Parquet files with bad rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.catalog import local_name
from grafloom.errors import GraphError
from grafloom.plans.runtime import keep

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: A line of N-Triples: subject, predicate, object (IRI, blank node or literal).
_SUBJECT, _IRI = r"(<[^>]*>|_:\S+)", r"<([^>]*)>"
_LITERAL = r'"((?:[^"\\]|\\.)*)"(?:@[A-Za-z-]+|\^\^<[^>]*>)?'
_LINE = rf"^\s*{_SUBJECT}\s+{_IRI}\s+(?:(<[^>]*>|_:\S+)|{_LITERAL})\s*\.\s*$"


def read_ntriples(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """`subject`, `predicate`, `object`, `literal`, and how many triples with blank nodes were left out. A line that
    is neither a triple, a comment nor blank is an error."""
    lines = spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'")
    part = lambda i: F.regexp_extract("value", _LINE, i)
    bad = lines.where(~F.col("value").rlike(_LINE)).limit(1).collect()
    if bad:
        raise GraphError(7050, f"no triple: {bad[0][0][:80]}")
    t = lines.select(part(1).alias("s"), part(2).alias("predicate"), part(3).alias("o"), _unescaped(part(4)).alias("literal"))
    blank = F.startswith("s", F.lit("_:")) | F.startswith("o", F.lit("_:"))
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    good = t.where(~blank).select(strip("s").alias("subject"), "predicate", F.when(F.col("o") != "", strip("o")).alias("object"), F.when(F.col("o") == "", F.col("literal")).alias("literal"))
    return good, t.where(blank).count()


def _unescaped(c: Column) -> Column:
    for a, b in ((r"\\n", "\n"), (r"\\t", "\t"), (r'\\"', '"'), (r"\\\\", r"\\")):
        c = F.regexp_replace(c, a, b)
    return c


_LOCAL = "([^/#:]*)$"


def _wide(ids: DataFrame, literals: DataFrame) -> tuple[DataFrame, int]:
    """`ids` with a column per property (`node_id`, `name`, `value`, `_row`): the last value of each, and how many values
    others replaced."""
    one = keep(literals.groupBy("node_id", "name").agg(F.max_by("value", "_row").alias("value"), F.count("*").alias("n")))
    names = [r[0] for r in one.select("name").distinct().orderBy("name").collect()]  # properties, few
    replaced = one.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    return (ids.join(one.groupBy("node_id").pivot("name", names).agg(F.first("value")), "node_id", "left") if names else ids), replaced


def _by_class(nodes: DataFrame) -> dict[str, DataFrame]:
    nodes = keep(nodes)
    return {r[0]: nodes.where(F.col("type") == r[0]).drop("type") for r in nodes.select("type").distinct().orderBy("type").collect()}


def lower_ntriples(triples: DataFrame, default_class: str, known: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame | None, int]:
    """Nodes by class (one row per subject or object, literals as columns, the last of several), edges `src, dst, type`,
    and the number of literals that later ones replaced. Ids without a type keep the class that they have in `known`
    (`node_id`, `known_`)."""
    local = lambda c: F.regexp_extract(c, _LOCAL, 1)
    triples = keep(triples.withColumn("_row", F.monotonically_increasing_id()))
    types = triples.where(F.col("predicate") == RDF_TYPE).groupBy(F.col("subject").alias("node_id")).agg(F.max_by(local("object"), "_row").alias("type"))
    ids = triples.select(F.col("subject").alias("node_id")).union(triples.where(f"predicate <> '{RDF_TYPE}'").select("object")).where("node_id is not null").distinct()
    typed = _typed(ids, types, known, F.lit(default_class))
    nodes, replaced = _wide(typed, triples.where("literal is not null").select(F.col("subject").alias("node_id"), local("predicate").alias("name"), F.col("literal").alias("value"), "_row"))
    edges = triples.where(f"object is not null and predicate <> '{RDF_TYPE}'").select(F.col("subject").alias("src"), F.col("object").alias("dst"), local("predicate").alias("type"))
    return _by_class(nodes), edges, replaced


def _typed(ids: DataFrame, types: DataFrame, known: DataFrame | None, default: Column) -> DataFrame:
    out = ids.join(types, "node_id", "left")
    if known is None:
        return out.withColumn("type", F.coalesce("type", default))
    return out.join(known.groupBy("node_id").agg(F.min("known_").alias("known_")), "node_id", "left").withColumn("type", F.coalesce("type", "known_", default)).drop("known_")


def lower_triples(triples: DataFrame, known: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame | None, int]:
    """Loose triples: `rdf:type`, `type` or `a` give the class, else the class in `known` (`node_id`, `known_`), else the
    id's prefix (`employee/E1`: Employee); objects that look like ids (`<..>`, with `://`, `urn:`, `/` or a colon in a
    word) are edges, others properties, of which the last value (`_row`) counts. Objects never seen as a subject become
    nodes with `_placeholder` true. Nodes by class, edges, and the number of values that later ones replaced."""
    t = triples.where("subject is not null and predicate is not null and object is not null")
    if "_row" not in t.columns:
        t = t.withColumn("_row", F.monotonically_increasing_id())
    is_type = F.col("predicate").isin("rdf:type", "type", "a", RDF_TYPE)
    resource = F.col("object").rlike(r"^<.*>$|://|^urn:|^[^\s/]+/[^\s/]+$|^[A-Za-z_]\w*:\S+$")
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    t = keep(t.select(strip("subject").alias("node_id"), strip("predicate").alias("predicate"), strip("object").alias("object"), is_type.alias("is_type"), resource.alias("resource"), "_row"))
    local = lambda c: F.regexp_extract(c, _LOCAL, 1)
    guess = F.initcap(F.regexp_extract("node_id", "([^/#:]+)[/#:][^/#:]*$", 1))
    types = t.where("is_type").groupBy("node_id").agg(F.max_by(local("object"), "_row").alias("type"))
    edges = t.where("not is_type and resource").select(F.col("node_id").alias("src"), F.col("object").alias("dst"), local("predicate").alias("type"))
    subjects = t.select("node_id").distinct().withColumn("_placeholder", F.lit(False))
    ends = edges.select(F.col("dst").alias("node_id")).distinct().join(subjects, "node_id", "left_anti").withColumn("_placeholder", F.lit(True))
    ids = _typed(subjects.unionByName(ends), types, known, F.coalesce(F.when(guess != "", guess), F.lit("Resource")))
    nodes, replaced = _wide(ids, t.where("not is_type and not resource").select("node_id", local("predicate").alias("name"), F.col("object").alias("value"), "_row"))
    return _by_class(nodes), None if edges.isEmpty() else edges, replaced


def shape_of(obj) -> tuple[str, dict | tuple]:  # noqa: ANN001
    """`node`, `edge` or `triple` and the data in one form, from: a triple; a dict with labels and properties; with
    start, end and type; with subject, predicate and object; with id and type; with src, dst and type."""
    if isinstance(obj, (list, tuple)) and len(obj) == 3:
        return "triple", tuple(obj)
    d = dict(obj)
    if {"subject", "predicate", "object"} <= set(d):
        return "triple", (d["subject"], d["predicate"], d["object"])
    if {"start", "end"} <= set(d):
        return "edge", {"src": d["start"], "dst": d["end"], "type": d.get("type", "RELATED"), **d.get("properties", {})}
    if {"src", "dst"} <= set(d):
        return "edge", {"type": "RELATED", **d}
    if "labels" in d:
        return "node", {"node_id": str(d.get("id", d.get("identity"))), "type": d["labels"][0], **d.get("properties", {})}
    if "iri" in d or "@id" in d:
        iri = d.pop("iri", None) or d.pop("@id")
        kind = d.pop("type", None) or d.pop("@type", None) or "Resource"
        return "node", {"node_id": iri, "type": local_name(kind), **d}
    if ("node_id" in d or "id" in d) and "type" in d:
        return "node", {"node_id": str(d.pop("node_id", None) or d.pop("id")), **d}
    raise GraphError(7060, f"unknown shape {sorted(d)}")


def _casts(df: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows in which every column has its type, and the others with `reason`."""
    tried = df.withColumns({f"{c}_t": F.col(c).try_cast(t) for c, t in columns.items()})
    failed = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(f"{c}_t").isNull(), F.lit(c)) for c in columns])) if columns else F.array().cast("array<string>")
    tried = tried.withColumn("bad_", failed)
    good = tried.where(F.size("bad_") == 0).select(*[F.col(f"{c}_t").alias(c) if c in columns else F.col(c) for c in df.columns])
    return good, tried.where(F.size("bad_") > 0).select(*df.columns, F.concat(F.lit("no value of its type: "), F.array_join("bad_", ", ")).alias("reason"))


def nodes_from_parquet(spark: SparkSession, path: str, column_map: dict[str, str] | None = None, types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Node rows of Parquet files, renamed and cast, and the rows set aside with a reason. An inbound `nid` is dropped."""
    df = spark.read.parquet(path).withColumnsRenamed(column_map or {}).drop("nid")
    return _casts(df, types or {})


def edges_from_parquet(spark: SparkSession, path: str, column_map: dict[str, str] | None = None, types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edge rows with `src` and `dst` as gids; rows where these are null, no numbers or negative are set aside."""
    df = spark.read.parquet(path).withColumnsRenamed(column_map or {})
    missing = [c for c in ("src", "dst") if c not in df.columns]
    if missing:
        raise GraphError(7031, f"no column {', '.join(missing)}")
    good, bad = _casts(df, {"src": "bigint", "dst": "bigint"} | (types or {}))
    ok = F.coalesce((F.col("src") >= 0) & (F.col("dst") >= 0), F.lit(False))
    lost = good.where(~ok).withColumns({"src": F.col("src").cast(dict(df.dtypes)["src"]), "dst": F.col("dst").cast(dict(df.dtypes)["dst"])})
    return good.where(ok), bad.unionByName(lost.select(*[F.col(c).cast(dict(df.dtypes)[c]).alias(c) for c in df.columns], F.lit("negative or missing end").alias("reason")))


def clean_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)
