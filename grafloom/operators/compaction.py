"""Far too many small files: which references to copy, into which containers, and containers of original bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafloom.functions.prefix import running_before
from grafloom.plans.runtime import cut, keep, ship

#: Ids per block of the running maxima, bytes per container.
BLOCK = 65_536
CONTAINER_BYTES = 128 * 1024 * 1024


def canonical_path(path: Column, folder: str, store: Column) -> Column:
    """A path as seen from its store, whatever it was spelled from: the store, its folder `<folder>/<store>/`, or
    anywhere that leads there. Back slashes, empty and `.` segments and `..` are resolved; null stays null."""
    home = F.array(F.lit(folder), store)
    plain = F.concat(F.lit(f"/{folder}/"), store, F.lit("/"), path)
    steps = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", "."))
    up = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    full = F.concat(F.lit("/"), F.array_join(F.aggregate(steps, home, up), "/"))
    # Most paths have nothing to resolve and need no fold.
    full = F.when(path.rlike(r"\\|//|^/|/$|(^|/)\.{1,2}(/|$)"), full).otherwise(plain)
    return F.when(path.isNotNull(), F.call_function("substring_index", full, F.concat(F.lit(f"/{folder}/"), store, F.lit("/")), F.lit(-1)))


def references(refs: DataFrame, kind: str, folder: str, start: str, stop: str) -> DataFrame:
    """References in one form: `store_kind`, `store`, `chunk_id`, `file`, `start`, `stop`, `n_bytes` (null is 0). Rows
    without chunk_id are dropped."""
    return refs.where("chunk_id is not null").select(
        F.lit(kind).alias("store_kind"), F.col("local_name").alias("store"), "chunk_id",
        canonical_path(F.col("path"), folder, F.col("local_name")).alias("file"),
        F.col(start).alias("start"), F.col(stop).alias("stop"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"),
    )


def resolved(refs: DataFrame) -> DataFrame:
    """`refs` with ranges: one that lacks an end takes the range given with the same file of its store, that of the
    smallest chunk_id if there are several; if there is none it stays null."""
    rows = keep(refs)
    has, file = F.col("start").isNotNull() & F.col("stop").isNotNull(), ["store_kind", "store", "file"]
    lacking = rows.where(~has).drop("start", "stop")
    known = rows.where(has).join(lacking.select(*file).distinct(), file, "left_semi").groupBy(*file).agg(F.min_by(F.struct("start", "stop"), "chunk_id").alias("r"))
    return rows.where(has).unionByName(lacking.join(known, file, "left").select(*lacking.columns, "r.start", "r.stop"))


_STORE = ["store_kind", "store"]


def _at(block: int) -> Column:
    return F.floor(F.col("start") / block)


def container_entries(refs: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the containers are to hold: `store_kind`, `store`, `chunk_id`, `file`, `n_bytes`, `start`, `stop` and
    `take_start`. From there to `stop` (exclusive) are the ids that count: the part of the range that no earlier entry
    has, so that each id listed is in the entries exactly once.

    A reference is an entry unless it holds no id, or another one of its store contains its range and is larger, or is
    equal and has a smaller chunk_id. References of one range are combined first, so copies cost nothing more. In order
    of start, and of equal starts the longer first, a range is contained in an earlier one if that order's running
    maximum of stops reaches its own; it is computed in blocks of ids, so that no task holds more than one.
    """
    spans = refs.where("start < stop").groupBy(*_STORE, "start", "stop").agg(F.min_by(F.struct("chunk_id", "file", "n_bytes"), "chunk_id").alias("r")).select(*_STORE, "start", "stop", "r.*")
    spans = running_before(keep(spans), _STORE, _at(block), [F.col("start"), F.desc("stop")], {"before": ("max", "stop")})
    return spans.where("before is null or before < stop").withColumn("take_start", F.greatest("start", "before")).drop("before")


def container_index(refs: DataFrame, target_bytes: int = CONTAINER_BYTES, block: int = BLOCK) -> DataFrame:
    """The entries with their places: `store_kind`, `store`, `chunk_id`, `file`, `container` (from 0 in each store),
    `offset` and `length` of the file's bytes in it, `take_start`, `take_stop`. Containers end at the first file that
    reaches `target_bytes`."""
    kept = running_before(keep(container_entries(refs, block)), _STORE, _at(block), [F.col("start")], {"ahead": ("sum", "n_bytes")})
    kept = kept.withColumn("ahead", F.coalesce("ahead", F.lit(0))).withColumn("container", F.floor(F.col("ahead") / target_bytes).cast("long"))
    base = kept.groupBy(*_STORE, "container").agg(F.min("ahead").alias("base"))
    return kept.join(base, [*_STORE, "container"]).select(
        *_STORE, "chunk_id", "file", "container", (F.col("ahead") - F.col("base")).alias("offset"), F.col("n_bytes").alias("length"), "take_start", F.col("stop").alias("take_stop")
    )


def held_elsewhere(refs: DataFrame, index: DataFrame) -> DataFrame:
    """The references with ids that are no entry of the containers, as other entries hold all their ids."""
    return refs.where("start < stop").join(index.select("store_kind", "chunk_id"), ["store_kind", "chunk_id"], "left_anti")


def container_plan(refs: DataFrame, target_bytes: int = CONTAINER_BYTES, block: int = BLOCK) -> DataFrame:
    """Every reference with its place in the index (`state` is `copied`) or the reason why it isn't copied: `covered`
    by another reference, `empty` (no id), `unknown` (no range anywhere)."""
    index = keep(container_index(refs, target_bytes, block))
    key = ["store_kind", "store", "chunk_id", "file"]
    place = ["container", "offset", "length", "take_start", "take_stop"]
    copied = index.select(*key, F.lit("copied").alias("state"), *place)
    none = [F.lit(None).cast("long").alias(c) for c in place]
    rest = refs.where("start is null or stop is null or start >= stop").select(*key, F.when(F.col("start").isNull() | F.col("stop").isNull(), "unknown").otherwise("empty").alias("state"), *none)
    return copied.unionByName(held_elsewhere(refs, index).select(*key, F.lit("covered").alias("state"), *none)).unionByName(rest)


INDEX = "container string, path string, offset bigint, length bigint, crc32 bigint"


def pack_files(files: DataFrame, folder: str, target_bytes: int = CONTAINER_BYTES, blocks: int = 1024) -> DataFrame:
    """Packs `files` (`path`, `content`) into container files in `folder` (a path or URI that all executors share).

    Returns the index: `container`, `path`, `offset`, `length`, `crc32`, one row per file; keep it with `folder`. The
    original bytes are kept as they are: null content counts as empty, a repeated path is kept as often as it comes.
    Rows with a null path are dropped. A container is written under a name of its own and then renamed, so a task
    that is run again leaves no part of it behind. Only containers of the plan are made: an empty input makes none.
    """
    ship(files.sparkSession)
    rows = files.where("path is not null").select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    sizes = rows.select("path", F.length("content").cast("long").alias("n")).groupBy("path").agg(F.sum("n").alias("n"))
    plan = running_before(sizes, [], F.pmod(F.xxhash64("path"), F.lit(blocks)), [F.col("path")], {"ahead": ("sum", "n")})
    plan = plan.select("path", F.floor(F.coalesce("ahead", F.lit(0)) / target_bytes).cast("long").alias("container"))
    placed = rows.join(plan, "path").repartition("container").sortWithinPartitions("container", "path")

    def write(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        where, root = _file_system(fs, folder)
        where.create_dir(root)
        out, at, name, part, now, index = None, 0, "", "", None, []

        def close() -> None:
            out.close()
            where.move(f"{root}/{part}", f"{root}/{name}")

        for batch in batches:
            for path, content, number in zip(batch["path"].to_pylist(), batch["content"], batch["container"].to_pylist(), strict=True):
                if number != now:
                    if out is not None:
                        close()
                    now, at, name = number, 0, f"container-{number:010d}.bin"
                    part = f".{name}.{uuid.uuid4().hex}"
                    out = where.open_output_stream(f"{root}/{part}")
                data = content.as_buffer()
                out.write(data)
                index.append((name, path, at, data.size, zlib.crc32(data)))
                at += data.size
            if len(index) >= 10_000:
                yield _index(pa, index)
                index = []
        if out is not None:
            close()
        yield _index(pa, index)

    return cut(placed.mapInArrow(write, INDEX))


def _file_system(fs, folder: str) -> tuple:  # noqa: ANN001
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def _index(pa, rows: list[tuple]):  # noqa: ANN001, ANN202
    kinds = [("container", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("crc32", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def read_packed(index: DataFrame, folder: str) -> DataFrame:
    """The files that `index` names (filter it to look some up): `path`, `content`. Fails if a checksum differs."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        where, root = _file_system(fs, folder)
        name, source = None, None
        for batch in batches:
            rows, size, got = batch.to_pylist(), 0, []
            for r in rows:
                if r["container"] != name:
                    name, source = r["container"], where.open_input_file(f"{root}/{r['container']}")
                data = source.read_at(r["length"], r["offset"])
                if zlib.crc32(data) != r["crc32"]:
                    raise ValueError(f"checksum of {r['path']} in {name} differs")
                got.append((r["path"], data))
                size += len(data)
                if size > 32 * 1024 * 1024:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()), pa.array([d for _, d in got], pa.binary())], names=["path", "content"])
                    size, got = 0, []
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()), pa.array([d for _, d in got], pa.binary())], names=["path", "content"])

    ship(index.sparkSession)
    return index.mapInArrow(read, "path string, content binary")
