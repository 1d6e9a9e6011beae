"""Stored indexes: tokens by hash for text, values in order for properties, lists by nearest centre for vectors."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grafloom.operators import text
from grafloom.plans.runtime import keep

#: Rows of a bucket of the token table, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 4096


def build_text(nodes: DataFrame, columns: list[str], folder: str) -> dict:
    """Writes each text once per token it has, in folders by the token's hash and sorted by token within."""
    entries = keep(text.text_entries(nodes, columns).withColumn("token", F.explode("tokens")))
    buckets = max(1, min(MOST_BUCKETS, math.ceil(entries.count() / BUCKET_ROWS)))
    placed = entries.withColumn("bucket_", _bucket(F.col("token"), buckets))
    # A frequent token's rows go to as many tasks as its texts need.
    placed.repartition("bucket_", F.shiftright(F.xxhash64("gid"), 62)).sortWithinPartitions("bucket_", "token").write.partitionBy("bucket_").parquet(folder)
    return {"folder": folder, "buckets": buckets, "schema": placed.schema.json()}


def _bucket(token, buckets: int):  # noqa: ANN001, ANN202
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def text_candidates(spark: SparkSession, built: dict, query: str) -> DataFrame:
    """The texts that share a token with `query`: only the folders of its tokens are read, and of these the row groups
    that may have them."""
    norm = text.normalized(F.lit(query))
    row = spark.range(1).select(F.array_distinct(F.split(norm, " ")).alias("t")).select(F.explode("t").alias("t")).where("t <> ''").select("t", _bucket(F.col("t"), built["buckets"]).alias("b")).collect()
    rows = spark.read.schema(StructType.fromJson(json.loads(built["schema"]))).parquet(built["folder"])
    hit = rows.where(F.col("bucket_").isin([r["b"] for r in row]) & F.col("token").isin([r["t"] for r in row]))
    return hit.drop("token", "bucket_").distinct()


def build_property(nodes: DataFrame, column: str, folder: str) -> dict:
    """Writes `value`, `gid` in order of value, so that a lookup reads the row groups that may have it."""
    rows = nodes.select(F.col(column).alias("value"), "gid")
    rows.repartitionByRange("value", "gid").sortWithinPartitions("value").write.parquet(folder)
    return {"folder": folder}


def property_gids(spark: SparkSession, built: dict, value) -> DataFrame:  # noqa: ANN001
    rows = spark.read.parquet(built["folder"])
    return rows.where(F.col("value").isNull() if value is None else F.col("value") == F.lit(value)).select("gid")
