"""Merged reads kept by month, of which only those are made anew whose tallies have changed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.days import as_date
from tidemark.operators.reads import merge_reads
from tidemark.plans.jobs import SOURCES, Stages
from tidemark.sinks.writers import write_by_month, write_parquet
from tidemark.sources.readers import read_parquet

#: What is known of a tally's file: where it is, how it looked, and the months of its days.
STATE = "source STRING, file STRING, changed TIMESTAMP, length BIGINT, months ARRAY<STRING>"
_SAME = ["source", "file", "changed", "length"]
#: The month of a day that is missing or malformed.
NO_MONTH = "none"


def refresh_merged(spark: SparkSession, stages: Stages, dates: str = "*/*") -> list[str]:
    """Merged reads under ``merged_months``, by year and month, brought up to date; the months made anew.

    The files of all tallies are compared, by name, time and size, with those of the last run. The months to
    make anew are those of the days in new or changed files, and those that changed or removed files had days in
    when they were read last: a log directory may hold days of another month. They are merged from all
    tallies that have such days and replace their directories; a month without any row left goes. What is
    known of the files is written last, so that a run that dies is simply repeated.
    """
    known, number = _last_state(spark, stages)
    listing = _listing(spark, stages, dates)
    fresh = listing.join(known.select(_SAME), _SAME, "left_anti")
    gone = known.join(listing.select(_SAME), _SAME, "left_anti")
    tallies = {source: _tally(spark, stages, source, dates) for source in SOURCES}
    state = _state_path(stages, number + 1)
    days = [
        tally.select(F.lit(source).alias("source"), F.col("_metadata.file_path").alias("file"), _month(tally).alias("month"))
        for source, tally in tallies.items() if tally is not None
    ]
    read = fresh
    months = F.lit(None).cast("array<string>").alias("months")
    if days:
        union = days[0]
        for more in days[1:]:
            union = union.unionByName(more)
        union = union.join(fresh.select("source", "file"), ["source", "file"], "left_semi")
        found = union.groupBy("source", "file").agg(F.collect_set("month").alias("months"))
        read = fresh.join(found, ["source", "file"], "left")
        months = F.coalesce("months", F.array().cast("array<string>")).alias("months")
    unchanged = known.join(listing.select(_SAME), _SAME, "left_semi")
    write_parquet(unchanged.unionByName(read.select(*_SAME, months)), f"{state}-pending")
    pending = read_parquet(spark, f"{state}-pending")
    touched = pending.join(known.select(_SAME), _SAME, "left_anti").select("months").unionByName(gone.select("months"))
    affected = sorted(r[0] for r in touched.select(F.explode("months")).distinct().collect())
    if affected:
        parts = [
            _empty(spark) if tally is None
            else tally.where(_month(tally).isin(affected)).select("d_dataset_id", as_date(tally, "day").alias("day"), "fract_read")
            for tally in tallies.values()
        ]
        path = stages.path("merged_months")
        write_by_month(merge_reads(*parts), path, "day")
        present = {r[0] for r in pending.select(F.explode("months")).distinct().collect()}
        for month in set(affected) - present:
            _remove(spark, f"{path}/{_folder(month)}")
    write_parquet(pending, state)
    _remove(spark, f"{state}-pending")
    return affected


def _month(tally: DataFrame) -> Column:
    return F.coalesce(F.date_format(as_date(tally, "day"), "yyyyMM"), F.lit(NO_MONTH))


def _folder(month: str) -> str:
    if month == NO_MONTH:
        return "/".join(f"{part}=__HIVE_DEFAULT_PARTITION__" for part in ("year", "month"))
    first = date(int(month[:4]), int(month[4:]), 1)
    return f"year={first.year}/month={first.month}"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    if files.exists(where):
        files.delete(where, True)


def _there(spark: SparkSession, stages: Stages, source: str, dates: str) -> bool:
    files, where = _files(spark, stages.path(source, dates))
    return bool(files.globStatus(where))


def _tally(spark: SparkSession, stages: Stages, source: str, dates: str) -> DataFrame | None:
    """The tally of a source; None where no directory matches."""
    if not _there(spark, stages, source, dates):
        return None
    return read_parquet(spark, stages.path(source, dates))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "d_dataset_id INT, day DATE, fract_read DOUBLE")


def _listing(spark: SparkSession, stages: Stages, dates: str) -> DataFrame:
    """The files of all tallies; their content is not read."""
    found = spark.createDataFrame([], STATE).drop("months")
    for source in SOURCES:
        if _there(spark, stages, source, dates):
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(stages.path(source, dates))
            found = found.unionByName(
                files.select(F.lit(source).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("changed"), "length")
            )
    return found


def _state_path(stages: Stages, number: int) -> str:
    return stages.path("merged_state", f"run-{number:06d}")


def _last_state(spark: SparkSession, stages: Stages) -> tuple[DataFrame, int]:
    """What the last finished run knew, and its number."""
    files, root = _files(spark, stages.path("merged_state"))
    done = []
    if files.exists(root):
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("run-") and not name.endswith("-pending"):
                success, where = _files(spark, f"{stages.path('merged_state', name)}/_SUCCESS")
                if success.exists(where):
                    done.append(int(name.removeprefix("run-")))
    if not done:
        return spark.createDataFrame([], STATE), 0
    return spark.read.schema(STATE).parquet(_state_path(stages, max(done))), max(done)
