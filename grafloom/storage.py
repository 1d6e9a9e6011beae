"""Tables of versions as Parquet files that are only ever added to, and the manifest that names those in use."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from grafloom.graph import CREATED, DELETED, union_all
from grafloom.plans.runtime import scratch

#: Files of ended versions from which a table is written anew.
MOST_ENDED = 32


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system that Spark knows; null if there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file aside and renames it, so a reader finds the old or the new one whole."""
    fs, aside = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    target = hadoop.Path(path)
    hadoop.FileContext.getFileContext(fs.makeQualified(aside).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(target), over)


class Store:
    """Tables by name in a folder. A table's `parts` hold versions of rows, its `ended` files which versions ended when.

    An insert adds a part and an upsert also a file of ended versions: neither reads or rewrites what is there. A reader
    joins the two; after `MOST_ENDED` such files the table is written as one part again.
    """

    def __init__(self, spark: SparkSession, folder: str | None, files: dict | None = None) -> None:
        self.spark, self.folder = spark, folder or scratch(spark, "database")
        self.files: dict[str, dict] = files or {}
        self._frames: dict[str, DataFrame] = {}

    def _write(self, name: str, df: DataFrame) -> str:
        file = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{file}")
        return file

    def names(self) -> list[str]:
        return list(self.files)

    def get(self, name: str) -> DataFrame | None:
        """All versions of a table, with the lsn at which each ended."""
        if name not in self.files:
            return None
        if name not in self._frames:
            by_schema: dict[str, list[str]] = {}
            for file, schema in self.files[name]["parts"]:
                by_schema.setdefault(schema, []).append(f"{self.folder}/{file}")
            rows = union_all([self.spark.read.schema(StructType.fromJson(json.loads(s))).parquet(*paths) for s, paths in by_schema.items()])
            ended = self.files[name]["ended"]
            if ended:
                key = self.key(name)
                gone = self.spark.read.schema(f"{key} bigint, {CREATED} bigint, ended_ bigint").parquet(*[f"{self.folder}/{f}" for f in ended])
                rows = rows.join(gone, [key, CREATED], "left").select(*[F.coalesce("ended_", DELETED).alias(DELETED) if c == DELETED else c for c in rows.columns])
            self._frames[name] = rows
        return self._frames[name]

    @staticmethod
    def key(name: str) -> str:
        return "gid" if name.startswith("nodes/") else "eid"

    def append(self, name: str, df: DataFrame) -> None:
        file = self._write(name, df)
        self.files.setdefault(name, {"parts": [], "ended": []})["parts"].append([file, df.schema.json()])
        self._frames.pop(name, None)

    def end(self, name: str, versions: DataFrame, lsn: int) -> None:
        """Ends versions (rows of the table) at `lsn`."""
        self.files[name]["ended"].append(self._write(f"{name}/ended", versions.select(self.key(name), CREATED, F.lit(lsn).cast("long").alias("ended_")).distinct()))
        self._frames.pop(name, None)
        if len(self.files[name]["ended"]) > MOST_ENDED:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Writes a table as one part; the old files stay for readers that use them."""
        df = self.get(name)
        self.files[name] = {"parts": [[self._write(name, df), df.schema.json()]], "ended": []}
        self._frames.pop(name, None)
