"""Streams into a graph: upserts per micro-batch, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grafloom.database import Database


def read_folder(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_nodes(stream: DataFrame, db: Database, checkpoint: str, key: str = "node_id", type_col: str = "type") -> StreamingQuery:
    """Every micro-batch is merged by key. A batch that is run again merges the same values, so nothing doubles."""
    return stream.writeStream.foreachBatch(lambda df, _: db.upsert_node_table(df, key, type_col) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; rows later than the watermark are left out. Works on tables and streams."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    out = events.groupBy(F.window(at, width, slide) if slide else F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(at, late)
    out = events.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), "n")
