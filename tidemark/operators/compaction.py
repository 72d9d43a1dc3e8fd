"""Rewriting a directory of many small files as a few large ones."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.session import shared_dir
from tidemark.sinks.bucketed import input_bytes
from tidemark.sinks.writers import write_parquet

#: Files that are fitted together in one task.
FILES_AT_ONCE = 10_000
#: Files whose places are sent to all tasks; with more of them their rows are shuffled by file first.
MOST_BROADCAST = 100_000
#: Bytes of the input, as they are stored, that ``compact`` gives one task to write.
MOST_BYTES = 64 << 20


def compact(spark: SparkSession, path: str, files: int, min_rows: int = 100, most_bytes: int = MOST_BYTES) -> str:
    """Rewrite the Parquet directory ``path`` as ``files`` files at ``<path>_group``.

    A file is written by one task, so there are more of them where ``files`` would take more than ``most_bytes``
    of the input each. Fewer than ``min_rows`` rows look like a failed read and are refused. The input stays as it is;
    its replacement is the caller's decision.
    """
    df = spark.read.parquet(path)
    if df.limit(min_rows).count() < min_rows:
        raise ValueError(f"{path}: fewer than {min_rows} rows, not compacted")
    target = path.rstrip("/") + "_group"
    write_parquet(df.repartition(max(files, -(-input_bytes(spark, path) // most_bytes))), target)
    return target


def fitted(files: DataFrame, target: int) -> DataFrame:
    """(file, length, output): files (file, length) put together into outputs of ``target`` bytes at most.

    First fit, the largest file first, within groups of FILES_AT_ONCE files dealt by name. A file
    that has more than half of ``target`` is an output of its own, and one output of a group at most has
    half or less, so that fitting outputs of such sizes again changes nothing. Outputs are numbered from 0.
    """
    groups = max(1, -(-files.count() // FILES_AT_ONCE))
    dealt = files.withColumn("part", F.pmod(F.xxhash64("file"), F.lit(groups)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        left: list[int] = []
        places = []
        ordered = group.sort_values(["length", "file"], ascending=[False, True])
        for size in ordered["length"].tolist():
            whole = 2 * size > target
            at = next((i for i, room in enumerate(left) if size <= room), None) if not whole else None
            if at is None:
                at = len(left)
                left.append(0 if whole else target)
            left[at] -= 0 if whole else size
            places.append(at)
        return ordered.assign(place=places)[["part", "file", "length", "place"]]

    schema = "part BIGINT, file STRING, length BIGINT, place BIGINT"
    spark = files.sparkSession
    path = shared_dir(spark, "fitted")
    write_parquet(dealt.select("part", "file", "length").groupBy("part").applyInPandas(fit, schema), path)
    placed = spark.read.schema(schema).parquet(path)
    counts = placed.groupBy("part").agg(F.max("place").alias("last")).orderBy("part").collect()
    before, at = [], 0
    for row in counts:
        before.append((row["part"], at))
        at += row["last"] + 1
    offsets = spark.createDataFrame(before, "part BIGINT, before BIGINT")
    numbered = placed.join(offsets, "part").withColumn("output", (F.col("place") + F.col("before")).cast("int"))
    return numbered.select("file", "length", "output")


def compact_by_size(spark: SparkSession, path: str, target: int = 256 << 20) -> tuple[int, int]:
    """Joins the small files of the Parquet directory ``path`` to files of about ``target`` bytes.

    Gives how many files there were and are. The rows are written to a directory beside, one task for each
    output, counted, and then put in the place of the old ones by renaming, which file systems do at once;
    the old directory is removed last. A run that dies before that leaves ``path`` as it was, one
    that dies between the two renames leaves the old rows at ``<path>_old-<id>``. Where no two files go
    together nothing is written. Partition directories are compacted one by one.
    """
    path = path.rstrip("/")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    plan = fitted(listed.select(F.col("_metadata.file_path").alias("file"), "length"), target)
    totals = plan.agg(F.count("*"), F.count_distinct("output")).first()
    files, outputs = totals
    if files == outputs:
        return files, files
    data = spark.read.parquet(path)
    rows = data.select("*", F.col("_metadata.file_path").alias("_file"))
    places = plan.select(F.col("file").alias("_file"), F.col("output").alias("_output"))
    places = F.broadcast(places) if files <= MOST_BROADCAST else places
    mark = uuid4().hex
    joined = rows.join(places, "_file").repartitionById(outputs, "_output")
    new, old = f"{path}_new-{mark}", f"{path}_old-{mark}"
    write_parquet(joined.select(*[F.col(f"`{c}`") for c in data.columns]), new)
    before, after = data.count(), spark.read.schema(data.schema).parquet(new).count()
    if before != after:
        raise ValueError(f"{path}: {before} rows, {after} after compaction; left as it was, see {new}")
    for source, place in ((path, old), (new, path)):
        _rename(spark, source, place)
    _filesystem(spark, old).delete(_path(spark, old), True)
    return files, outputs


def compact_partitions(spark: SparkSession, paths: Iterator[str] | list[str], target: int = 256 << 20) -> dict[str, tuple[int, int]]:
    """``compact_by_size`` of several directories, as of days or months, one after another."""
    return {path: compact_by_size(spark, path, target) for path in paths}


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, source: str, target: str) -> None:
    if not _filesystem(spark, source).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"could not rename {source} to {target}")
