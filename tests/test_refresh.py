"""Months made anew equal a full rebuild."""

import shutil
from pathlib import Path

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from tidemark.functions.days import as_date
from tidemark.operators.reads import merge_reads
from tidemark.plans import refresh
from tidemark.plans.jobs import SOURCES, Stages


def add(spark, stages, source, folder, *rows):
    df = spark.createDataFrame(list(rows), "d_dataset_id int, day string, fract_read double").coalesce(1)
    df.write.mode("append").parquet(stages.path(source, folder))


def merged(spark, stages):
    df = spark.read.parquet(stages.path("merged_months"))
    return as_set(df.select("d_dataset_id", "day", "fract_read", "cmssw_read", "xroot_read", "classad_read"))


def rebuilt(spark, stages):
    """One pass over all tallies there are."""
    parts = []
    for source in SOURCES:
        if Path(stages.path(source)).exists() and list(Path(stages.path(source)).glob("*/*/*.parquet")):
            tally = spark.read.parquet(stages.path(source, "*/*"))
        else:
            tally = spark.createDataFrame([], "d_dataset_id int, day string, fract_read double")
        parts.append(tally.withColumn("day", as_date(tally, "day")))
    df = merge_reads(*parts)
    return as_set(df.select("d_dataset_id", "day", "fract_read", "cmssw_read", "xroot_read", "classad_read"))


@pytest.fixture
def stages(tmp_path):
    return Stages(str(tmp_path / "out"))


def test_late_changed_and_removed_logs(spark, stages):
    assert refresh.refresh_merged(spark, stages) == []
    add(spark, stages, "cmssw", "2020/01", (1, "20200105", 0.5), (1, "20200201", 0.25))
    add(spark, stages, "xrootd", "2020/02", (1, "20200201", 1.0), (2, "20200210", 2.0))
    add(spark, stages, "classads", "2020/03", (3, "20200301", 1.0), (3, "bad day", 1.0), (None, "20200302", 7.0))
    assert refresh.refresh_merged(spark, stages) == ["202001", "202002", "202003", "none"]
    assert merged(spark, stages) == rebuilt(spark, stages)
    assert refresh.refresh_merged(spark, stages) == []

    # a late file in January's directory, with a day of February
    add(spark, stages, "cmssw", "2020/01", (1, "20200131", 0.125), (2, "20200210", 3.0))
    untouched = {p: p.stat().st_mtime_ns for p in Path(stages.path("merged_months")).glob("year=2020/month=3/*")}
    assert refresh.refresh_merged(spark, stages) == ["202001", "202002"]
    assert merged(spark, stages) == rebuilt(spark, stages)
    assert untouched and all(p.stat().st_mtime_ns == t for p, t in untouched.items())

    # a directory goes, and with it all of March and the malformed day
    shutil.rmtree(stages.path("classads", "2020/03"))
    assert refresh.refresh_merged(spark, stages) == ["202003", "none"]
    assert merged(spark, stages) == rebuilt(spark, stages)
    assert refresh.refresh_merged(spark, stages) == []


def test_a_run_that_died_is_repeated(spark, stages, monkeypatch):
    add(spark, stages, "cmssw", "2020/01", (1, "20200105", 0.5))
    real = refresh.write_parquet

    def dies(df, path):
        if not path.endswith("-pending"):
            raise OSError("executor lost")
        real(df, path)

    monkeypatch.setattr(refresh, "write_parquet", dies)
    with pytest.raises(OSError):
        refresh.refresh_merged(spark, stages)
    monkeypatch.undo()
    assert refresh.refresh_merged(spark, stages) == ["202001"]
    assert merged(spark, stages) == rebuilt(spark, stages)


def test_only_rows_of_affected_months_are_merged(spark, stages, monkeypatch):
    add(spark, stages, "cmssw", "2020/01", *[(i, "20200105", 0.5) for i in range(50)])
    refresh.refresh_merged(spark, stages)
    add(spark, stages, "cmssw", "2020/02", (1, "20200205", 0.5))
    seen = []
    real = refresh.merge_reads

    def counted(*parts):
        seen.append(sum(part.count() for part in parts))
        return real(*parts)

    monkeypatch.setattr(refresh, "merge_reads", counted)
    assert refresh.refresh_merged(spark, stages) == ["202002"]
    assert seen == [1]
    assert spark.read.parquet(stages.path("merged_months")).agg(F.count("*")).first()[0] == 51
