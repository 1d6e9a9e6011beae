"""Token index and text search over node properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafloom.graph import union_all

#: Scores of the kinds of match.
EXACT, NORMALIZED, PREFIX, ALL_TOKENS, PARTIAL, PARTIAL_RATIO = 4.0, 3.5, 3.0, 2.5, 1.0, 0.5


def normalized(c: Column) -> Column:
    """Lower case, every run of other characters than letters, digits and `_` as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "(?U)[^\\w]+", " "))


def text_entries(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """`gid`, `property`, `pos` (of the property), `text`, `norm`, `tokens`: one row per text; lists give several."""
    parts = []
    for i, c in enumerate(columns):
        value = F.explode(c) if dict(nodes.dtypes)[c].startswith("array") else F.col(c).cast("string")
        parts.append(nodes.select("gid", F.lit(c).alias("property"), F.lit(i).alias("pos"), value.alias("text")))
    e = union_all(parts).where("text is not null").withColumn("norm", normalized(F.col("text"))).where("norm <> ''")
    return e.withColumn("tokens", F.array_distinct(F.split("norm", " ")))


def text_search(entries: DataFrame, query: str, top_k: int) -> DataFrame:
    """The `top_k` nodes: `gid`, `property`, `text`, `kind`, `score`, `rank`.

    Candidates are texts equal to the query and those that share a token with it. Kinds: exact 4, normalized 3.5,
    prefix 3, all tokens 2.5, partial 1 + half the share of the query's tokens found. A node's best text is the one
    with the greatest score, then the first property, then the least text; nodes by score, gid, property, text.
    """
    q = F.lit(query)
    nq = normalized(q)
    qt = F.array_distinct(F.split(nq, " "))
    shared = F.size(F.array_intersect("tokens", qt))
    hit = entries.where((F.col("text") == q) | ((F.length(nq) > 0) & F.arrays_overlap("tokens", qt)))
    kind = (
        F.when(F.col("text") == q, "exact").when(F.col("norm") == nq, "normalized").when(F.startswith(F.col("norm"), nq), "prefix")
        .when(shared == F.size(qt), "all_tokens").otherwise("partial")
    )
    scores = {"exact": EXACT, "normalized": NORMALIZED, "prefix": PREFIX, "all_tokens": ALL_TOKENS}
    hit = hit.withColumn("kind", kind)
    value = F.lit(PARTIAL) + PARTIAL_RATIO * shared / F.size(qt)
    for k, v in scores.items():
        value = F.when(F.col("kind") == k, v).otherwise(value)
    hit = hit.withColumn("score", value)
    best = hit.groupBy("gid").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "text", "property", "kind")).alias("m"))
    rows = best.select("gid", "m.property", "m.text", "m.kind", (-F.col("m.s")).alias("score"))
    order = [F.desc("score"), F.col("gid"), F.col("property"), F.col("text")]
    return rows.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # top_k rows


def token_index(entries: DataFrame) -> DataFrame:
    """`token`, `documents`, `texts`: how many nodes and texts have each token."""
    return entries.select("gid", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_distinct("gid").alias("documents"), F.count("*").alias("texts"))
