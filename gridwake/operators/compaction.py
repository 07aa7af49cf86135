"""Consolidation of tiny files, partition by partition, without losing or doubling a record.

``plan_records`` decides for every distinct record which file keeps it; ``plan_files`` says which partitions
have too many small files, into how many outputs they go, and which files add nothing. ``compact`` rewrites
only those partitions by dynamic overwrite, under a snapshot log with optimistic conflict checks; ``append`` and ``read``
go by the same log.
"""

from __future__ import annotations

import functools
import json
import re
import time
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = ["tile", "year", "chunk_row", "chunk_col"]
RECORD = [*CHUNK, "point_id", "date", "source"]


def chunk_of_path(path: Column) -> dict[str, Column]:
    """Tile, year, row and column from a path of any style: the tile and its row and column stand together."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(flat, pattern, group), F.lit(""))
    code = r"([0-9]{1,2}[A-Za-z]{3})_[rR]([0-9]+)_[cC]([0-9]+)"
    return {
        "tile": F.upper(part(code, 1)),
        "year": part(r"(?:^|/)([0-9]{4})/").cast("int"),
        "chunk_row": part(code, 2).cast("int"),
        "chunk_col": part(code, 3).cast("int"),
    }


def chunk_files(reports: DataFrame) -> DataFrame:
    """One row per file with its chunk, taken from the path; a null path leaves the chunk to the stated columns."""
    found = chunk_of_path(F.col("path"))
    stated = {
        "tile": F.upper("tile"), "year": F.col("year"),
        "chunk_row": F.when(F.col("chunk_row") >= 0, F.col("chunk_row")),
        "chunk_col": F.when(F.col("chunk_col") >= 0, F.col("chunk_col"))
    }
    return reports.where("file_id IS NOT NULL").groupBy("file_id").agg(
        F.min("path").alias("path"), *[F.min(stated[c]).alias(c) for c in CHUNK],
        F.max("size_bytes").alias("size_bytes")
    ).select("file_id", *[F.coalesce(found[c], F.col(c)).alias(c) for c in CHUNK], "size_bytes")


def plan_records(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Every distinct record once, with the smallest file_id that holds it and that file's value.

    Records are the same when chunk, point, date and source agree (nulls agree with nulls). Rows of unknown
    files are left out. Where copies differ in value, that of the keeping file stays; within one file the
    smallest. The aggregation combines before its shuffle, and its key holds point and date, so that a
    chunk with a third of all rows is spread over all tasks.
    """
    slim = rows.select("file_id", "point_id", "date", "source", "value")
    placed = slim.join(files.select("file_id", *CHUNK), "file_id")
    return placed.groupBy(*RECORD).agg(F.min(F.struct("file_id", "value")).alias("k")).select(
        *RECORD, F.col("k.file_id").alias("file_id"), F.col("k.value").alias("value")
    )


def redundant_files(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files that keep no record of the plan: each of theirs stands in an earlier file, or they are empty."""
    return files.select("file_id").join(records.select("file_id").distinct(), "file_id", "left_anti")


def plan_partitions(
    files: DataFrame, records: DataFrame, small_bytes: int, min_small: int, target_rows: int
) -> DataFrame:
    """Per chunk: file counts, records, and whether and into how many files it is rewritten."""
    counts = files.groupBy(*CHUNK).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("size_bytes") < small_bytes).alias("n_small")
    )
    kept = records.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n_records"))
    joined = counts.alias("c").join(
        kept.alias("k"), [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in CHUNK], "left"
    ).select("c.*", F.coalesce("n_records", F.lit(0)).alias("n_records"))
    return joined.withColumn("rewrite", F.col("n_small") >= min_small).withColumn(
        "n_out", F.when(F.col("rewrite"), F.ceil(F.col("n_records") / target_rows)).otherwise(F.col("n_files"))
    )


# ---- the write side: a directory table with a snapshot log -------------------------------------------
#
# Every write has a version of its own, a last level of the directories: data/<partition>/version=<id>. A snapshot says which versions
# make up each partition. Files are never changed or replaced, so whoever reads a snapshot sees all of it, whatever is
# written meanwhile, and a write that isn't committed is not seen at all.


class ConflictError(RuntimeError):
    """Another writer replaced a version that this one read."""


class SnapshotLog:
    """Numbered snapshots beside a directory table.

    An entry is written whole under another name and takes its number by a rename that fails if the number is taken, so commits are
    serial and no reader ever meets half an entry. An entry states what became of the partitions it touched: for each, the
    versions that are live after it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.root = spark, spark._jvm, root
        self.path = self.jvm.org.apache.hadoop.fs.Path(f"{root}/_snapshots")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path.getFileSystem(self.conf)
        self.fs.mkdirs(self.path)

    def _file(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def latest(self) -> int:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._file(f"{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def live(self, version: int | None = None) -> dict[str, list[str]]:
        """Per partition (its directory) the versions that make it up at a snapshot."""
        state: dict[str, list[str]] = {}
        for number in range(1, (self.latest() if version is None else version) + 1):
            state.update(self.read(number)["partitions"])
        return {k: v for k, v in state.items() if v}

    def _claim(self, entry: dict, number: int) -> bool:
        """Whether the entry took the number; false if another one has it."""
        draft = self._file(f"_draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(
            self.path.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), self.conf
        )
        plain = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._file(f"{number:012d}.json"), plain)
        except Exception as e:
            self.fs.delete(draft, False)
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def commit(self, note: str, schema: str, add: dict[str, str], remove: dict[str, list[str]] | None = None) -> int:
        """Takes the next number: ``add`` names each touched partition's new version, ``remove`` those it stands for.

        Fails with ``ConflictError`` if one of the removed versions is no longer live: then another rewrite came first. Versions
        appended meanwhile stay live beside the new one.
        """
        remove = remove or {}
        while True:
            number = self.latest() + 1
            now, after = self.live(number - 1), {}
            for partition in {*add, *remove}:
                gone, there = remove.get(partition, []), now.get(partition, [])
                if not set(gone) <= set(there):
                    raise ConflictError(f"{partition} was rewritten by another writer")
                after[partition] = [v for v in there if v not in gone] + ([add[partition]] if partition in add else [])
            entry = {"at": time.time(), "note": note, "schema": schema, "partitions": after}
            if self._claim(entry, number):
                return number

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.read(self.latest() if version is None else version)["schema"]))


def _write(spark: SparkSession, root: str, df: DataFrame, keys: Sequence[str]) -> dict[str, str]:
    """Writes ``df`` as a new version by dynamic overwrite: a task or job that runs again replaces its own output only.

    Returns the version of each partition written.
    """
    version = uuid.uuid4().hex
    data = f"{root}/data"
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*keys, "version").parquet(data)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    found = fs_path(data).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
        fs_path(f"{data}/{'*/' * len(keys)}version={version}")
    )
    depth = len(keys)
    return {"/".join(str(f.getPath().toUri().getPath()).split("/")[-depth - 1 : -1]): version for f in found or []}


def _paths(root: str, live: dict[str, list[str]]) -> list[str]:
    return [f"{root}/data/{_escaped(p)}/version={v}" for p, versions in sorted(live.items()) for v in versions]


def _escaped(path: str) -> str:
    """A literal path where Spark takes patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _values(partition: str) -> list[str | None]:
    """The key values of a partition's directory, as text."""
    texts = [unquote(level.split("=", 1)[1]) for level in partition.split("/")]
    return [None if t == "__HIVE_DEFAULT_PARTITION__" else t for t in texts]


def append(spark: SparkSession, root: str, df: DataFrame, keys: Sequence[str]) -> int:
    """Adds rows to the table at ``root``, partitioned by ``keys``; they are there with the snapshot it returns, or not at all.

    An empty text as key is stored as null, as Spark's partitions do. Appends never conflict: a consolidation that runs at the same time leaves the new version beside its own. A table must keep its
    columns. Adding no rows makes no partition, but a snapshot.
    """
    log = SnapshotLog(spark, root)
    return log.commit("append", df.schema.json(), _write(spark, root, df, keys))


def read(
    spark: SparkSession, root: str, version: int | None = None, partitions: dict[str, list[str]] | None = None
) -> DataFrame:
    """The table at a snapshot (the latest by default), or the given versions of its partitions."""
    log = SnapshotLog(spark, root)
    live = log.live(version) if partitions is None else partitions
    schema = log.schema(version)
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option(
        "basePath", f"{root}/data"
    ).parquet(*_paths(root, live)).select(*schema.names)


def file_sizes(spark: SparkSession, root: str, live: dict[str, list[str]]) -> DataFrame:
    """``(partition, bytes)`` of every file, from listings alone: no file is opened."""
    listing = spark.read.format("binaryFile").option(
        "pathGlobFilter", "*.parquet"
    ).load(_paths(root, live)).select("path", "length")
    return listing.select(
        F.regexp_extract("path", r"/data/(.+)/version=[0-9a-f]+/[^/]+$", 1).alias("partition"),
        F.col("length").alias("bytes")
    )


def compact(
    spark: SparkSession, root: str, keys: Sequence[str], identity: Sequence[str], small_bytes: int, min_small: int,
    target_bytes: int, first: Sequence[str] = (), before_commit=None
) -> int:
    """Rewrites the partitions of the table at ``root`` that hold at least ``min_small`` files under ``small_bytes``.

    Returns the new snapshot's number (the old one if nothing was to do). Records that agree in ``keys`` and ``identity`` come out
    once; of those that differ otherwise the smallest stays, compared by the columns ``first`` and then by the others. Nulls
    agree with nulls. A partition is split by a hash of the record into files of about ``target_bytes``, so that a hot
    partition isn't one task's work; the aggregation combines before its shuffle.

    Nothing that was read is changed: the new version is written beside the old ones and takes their place with the snapshot. If
    another rewrite of one of the partitions was committed meanwhile, ``ConflictError`` is raised and the table stays as
    it was; appended rows are kept. A crash before the commit leaves the old snapshot, one after it the new.
    Paths of chosen partitions go to the driver, as those of all files do in Spark's own index.
    """
    log = SnapshotLog(spark, root)
    base = log.latest()
    live = log.live(base)
    if not live:
        return base
    counts = file_sizes(spark, root, live).groupBy("partition").agg(
        F.count_if(F.col("bytes") < small_bytes).alias("n_small"), F.sum("bytes").alias("bytes")
    )
    chosen = {
        r["partition"]: max(1, -(-r["bytes"] // target_bytes))
        for r in counts.where(F.col("n_small") >= min_small).toLocalIterator()
    }
    read_versions = {p: live[p] for p in chosen}
    if not chosen:
        return base
    table = read(spark, root, base, read_versions)
    schema = table.schema
    outputs = spark.createDataFrame(
        [(*_values(p), n) for p, n in chosen.items()], ", ".join(f"`{k}` string" for k in keys) + ", _outputs long"
    )
    others = [*first, *[c for c in schema.names if c not in (*keys, *identity, *first)]]
    by = [*keys, *identity]
    once = table.groupBy(*by).agg(F.min(F.struct(*others, F.lit(0).alias("_"))).alias("_o")).alias("t")
    match = functools.reduce(Column.__and__, [F.col(f"t.{k}").cast("string").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    # A left join: a partition whose name reads otherwise than its key still keeps all its rows, in one file.
    sized = once.join(outputs.alias("o"), match, "left").select(
        "t.*", F.pmod(F.xxhash64(*[f"t.{c}" for c in identity]), F.coalesce("_outputs", F.lit(1))).alias("_file")
    )
    flat = sized.select(
        *by, *[F.col(f"_o.{c}").alias(c) for c in others], "_file"
    ).repartition(*keys, "_file").sortWithinPartitions(*keys, *identity)
    written = _write(spark, root, flat.select(*schema.names), keys)
    if before_commit:
        before_commit()
    return log.commit("compact", schema.json(), written, read_versions)


def expire(spark: SparkSession, root: str, keep: int = 1, older_than_s: float = 86_400.0) -> int:
    """Deletes versions that none of the last ``keep`` snapshots names; returns how many.

    Versions no snapshot ever named are deleted too, if they are older than ``older_than_s``: they may belong to a write that is
    still going on. Readers of the kept snapshots aren't disturbed.
    """
    log = SnapshotLog(spark, root)
    latest = log.latest()
    needed = {
        (p, v) for number in range(max(latest - keep + 1, 0), latest + 1) for p,
        versions in log.live(number).items() for v in versions
    }
    named = {
        v for number in range(1, latest + 1) for versions in log.read(number)["partitions"].values() for v in versions
    }
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    deleted = 0
    pending = [fs_path(f"{root}/data")]
    while pending:
        for status in log.fs.listStatus(pending.pop()):
            name = status.getPath().getName()
            if not status.isDirectory() or name.startswith(("_", ".")):
                continue
            if not name.startswith("version="):
                pending.append(status.getPath())
                continue
            partition = str(status.getPath().getParent().toUri().getPath()).split("/data/", 1)[1]
            version = name.removeprefix("version=")
            fresh = version not in named and status.getModificationTime() / 1000 > time.time() - older_than_s
            if (partition, version) not in needed and not fresh:
                log.fs.delete(status.getPath(), True)
                deleted += 1
    return deleted
