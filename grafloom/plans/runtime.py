"""Session factory, lineage cuts and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of Parquet, up to which `broadcast_if_small` broadcasts.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 * 1024 * 1024
#: Keys up to which a set of rows is looked up by an IN filter in the scan: some 100 kB in the plan.
IN_KEYS = 10_000


def session(app: str = "grafloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster, use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's `spark.checkpoint.dir`.

    Only where none is set and the master is local is a folder of this machine used, which goes when the program ends;
    on a cluster without the setting this fails rather than writing where other machines can't read.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="grafloom-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


_scratch: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder. Where that is a mounted file system, such folders go when the program ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.add(folder)
    return folder


def _sweep() -> None:
    for f in _scratch:
        path = f.removeprefix("file:")
        if path.startswith("/"):
            shutil.rmtree("/" + path.lstrip("/"), ignore_errors=True)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that its plan ends here."""
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    # New column ids: the optimizer's notes on the old ones may name columns that a checkpoint no longer has.
    return kept.toDF(*kept.columns)


class Kept:
    """A table in the shared folder that grows by parts: each is computed once and written as Parquet, so that what reads
    them takes the columns and rows that it needs, and the optimizer knows their size."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.paths, self.schema = spark, scratch(spark, "kept"), [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes `df` and returns it as written."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        self.schema = df.schema
        self.paths.append(path)
        return self._read(path)

    def all(self) -> DataFrame:
        return self._read(*self.paths)

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)


def keep(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the shared folder as Parquet."""
    return Kept(df.sparkSession).add(df)


def few(df: DataFrame, column: str, most: int = IN_KEYS) -> list | None:
    """The distinct values of a column, null if there are more than `most` rows."""
    got = df.select(column).limit(most + 1).collect()
    return None if len(got) > most else sorted({r[0] for r in got if r[0] is not None})


def among(column: str, values: list) -> Column:
    """Whether a column (by name) is one of `values`, whole numbers or strings. One text for the parser, as a call per
    value takes longer than the query."""
    if not values:
        return F.lit(False)
    name = "`" + column.replace("`", "``") + "`"
    write = lambda v: f"{v}L" if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"{name} in ({', '.join(map(write, values))})")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` computed once; marked for broadcast if it has at most `rows` rows and `BROADCAST_BYTES` as written, else left to
    the optimizer, which knows its size. The joins that use this are right either way."""
    kept = keep(df)
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(kept) if size <= BROADCAST_BYTES and kept.limit(rows + 1).count() <= rows else kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application; operators with Python code call it."""
    sc = spark.sparkContext
    if getattr(sc, "_grafloom_shipped", False):
        return
    here = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="grafloom-code-")) / "grafloom.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(name))
    sc._grafloom_shipped = True
