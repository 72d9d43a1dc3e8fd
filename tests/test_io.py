import gzip
import json
import time
from datetime import date

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from tidemark.operators.compaction import compact
from tidemark.operators.quality import dataset_sizes_check, null_counts, window_totals
from tidemark.plans.session import shared_dir
from tidemark.sinks import writers
from tidemark.sinks.writers import (
    packed,
    stage_label,
    write_by_month,
    write_csv,
    write_json,
    write_parquet,
    write_single_csv,
    write_sorted_parquet,
)
from tidemark.sources.layouts import LAYOUTS, LOG_LAYOUTS, layout, log_layout
from tidemark.sources.readers import (
    read_catalog_replicas,
    read_csv,
    read_json,
    read_log,
    read_overrides,
    read_parquet,
    read_snapshots,
)

FIELD_COUNTS = {
    "processing_eras": 5,
    "acquisition_eras": 7,
    "dataset_access_types": 2,
    "data_tiers": 4,
    "datasets": 16,
    "blocks": 11,
    "files": 17,
    "mod_configs": 3,
    "out_configs": 9,
    "rel_versions": 2,
    "file_lumis": 3,
    "replica_summary": 5,
    "block_replicas": 28,
    "catalog_replicas": 11,
    "file_access_records": 27,
    "job_records": 44,
    "output_transfers": 28,
    "user_activity": 15,
    "federation_reads": 3,
    "disk_pool_reads": 3,
}


def test_layouts(spark):
    assert {name: len(layout(name).fields) for name in LAYOUTS} == FIELD_COUNTS
    assert all(f.nullable for name in LAYOUTS for f in layout(name).fields)
    for source in LOG_LAYOUTS:
        (wrapper,) = log_layout(source).fields
        assert (wrapper.name, wrapper.nullable) == ("data", False)


def test_read_log_globs_gzip(spark, tmp_path):
    for day, name in (("01", "a"), ("02", "b")):
        folder = tmp_path / "2020/01" / day
        folder.mkdir(parents=True)
        record = {"data": {"file_lfn": name, "end_time": 5, "extra": 1}, "metadata": {"x": 1}}
        with gzip.open(folder / "part.json.gz", "wt") as out:
            out.write(json.dumps(record) + "\n")
    log = read_log(spark, "cmssw", f"{tmp_path}/2020/01/*/*.json.gz")
    assert log.columns == ["file_lfn", "end_time", "app_info", "site_name"]
    assert as_set(log) == [("a", 5, None, None), ("b", 5, None, None)]


def test_read_csv(spark, tmp_path):
    (tmp_path / "rel.csv").write_text("1,REL_1\n2,null\n")
    path = str(tmp_path / "rel.csv")
    assert as_set(read_csv(spark, path, "rel_versions")) == [(1, "REL_1"), (2, None)]
    assert as_set(read_csv(spark, path, "a INT, b STRING", header=True)) == [(2, None)]
    assert as_set(read_csv(spark, path)) == [("1", "REL_1"), ("2", None)]


def test_read_csv_fails_fast(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1,REL_1\nword,REL_2\n")
    with pytest.raises(Exception, match="FAILFAST"):
        read_csv(spark, str(tmp_path / "bad.csv"), "rel_versions").collect()


def test_read_snapshots_prunes_days(spark, tmp_path):
    for day, now in (("2019-12-31", 1), ("2020-01-01", 2), ("2020-01-02", 3)):
        folder = tmp_path / f"time={day}"
        folder.mkdir()
        (folder / "part-0").write_text(",".join([str(float(now)), "d"] + ["null"] * 26) + "\n")
    snapshots = read_snapshots(spark, str(tmp_path), "2020-01-01", "2020-01-01")
    assert as_set(snapshots.select("now_sec", "dataset_name", "br_user_group_id", "time")) == [
        (2.0, "d", None, date(2020, 1, 1))
    ]
    assert len(snapshots.inputFiles()) >= 1
    plan = snapshots._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(time" in plan
    assert read_snapshots(spark, str(tmp_path)).count() == 3


def test_read_catalog_replicas_names_the_file(spark, rows, tmp_path):
    path = f"{tmp_path}/rucio/2020-12-11/replicas"
    write_parquet(rows("NAME string", ("a",)), path)
    (row,) = read_catalog_replicas(spark, path, "parquet").collect()
    assert "/rucio/2020-12-11/replicas/part-" in row["filename"]


def test_read_overrides(spark, tmp_path):
    path = tmp_path / "overrides.json"
    path.write_text('{\n  "/A/a/RAW": 3,\n  "/B/b/AOD": 0,\n  "/A/a/RAW": 5\n}\n')
    assert as_set(read_overrides(spark, str(path))) == [("/A/a/RAW", 5), ("/B/b/AOD", 0)]
    (tmp_path / "z.json").write_text('{"/B/b/AOD": 9}')
    assert as_set(read_overrides(spark, f"{tmp_path}/*.json"))[1] == ("/B/b/AOD", 9)
    path.write_text("{}")
    assert read_overrides(spark, str(path)).count() == 0


def test_writers_replace(spark, rows, tmp_path):
    df = rows("a int, b string", (1, "x"), (2, None))
    for write, read in (
        (write_parquet, read_parquet),
        (write_csv, lambda s, p: read_csv(s, p, "a INT, b STRING", header=True)),
        (write_single_csv, lambda s, p: read_csv(s, p, "a INT, b STRING", header=True)),
        (write_json, lambda s, p: read_json(s, p, "a INT, b STRING")),
    ):
        path = f"{tmp_path}/{write.__name__}"
        write(df.union(df), path)
        write(df, path)
        assert as_set(read(spark, path)) == [(1, "x"), (2, None)], write.__name__
    assert len(list((tmp_path / "write_single_csv").glob("*.csv"))) == 1
    assert len(list((tmp_path / "write_parquet").glob("*.snappy.parquet"))) >= 1


def test_json_keeps_arrays(spark, rows, tmp_path):
    df = rows("name array<double>", ([0.5, 1e15, 0.0],))
    write_json(df, f"{tmp_path}/a")
    assert as_set(read_json(spark, f"{tmp_path}/a")) == as_set(df)


def test_write_sorted_parquet(spark, tmp_path):
    df = spark.range(2000).selectExpr("id % 7 AS date", "id AS dataset_id", "1.0 AS size")
    path = f"{tmp_path}/sorted"
    write_sorted_parquet(df.repartition(4), path, "date", "dataset_id")
    stored = read_parquet(spark, path)
    assert as_set(stored) == as_set(df)
    within = stored.groupBy(F.input_file_name().alias("f")).agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    spans = sorted((r.lo, r.hi) for r in within.collect())
    assert all(hi <= lo for (_, hi), (lo, _) in zip(spans, spans[1:]))
    for file in stored.inputFiles():
        rows = [tuple(r)[:2] for r in spark.read.parquet(file).collect()]
        assert rows == sorted(rows)


def test_packed_keys_ascend_with_the_keys(spark, rows, tmp_path):
    days = [None, date(1, 1, 1), date(1969, 12, 31), date(2020, 1, 5), date(9999, 12, 31)]
    ids = [None, -(1 << 63), -(1 << 39) - 1, -1, 0, 7, (1 << 39) - 1, 1 << 39, (1 << 63) - 1]
    df = rows("date date, id bigint", *[(d, i) for d in days for i in ids])
    far = df.selectExpr("CASE WHEN id % 2 = 0 THEN 2147483647 WHEN id < 0 THEN -2147483648 ELSE 8388607 END AS date", "id")
    for some in (df, far):
        both = some.select(packed(some, "date", "id")[0].alias("p"), "date", "id").distinct().collect()
        lines = sorted(([(v is not None, v) for v in (r.date, r.id)], (r.p is not None, r.p)) for r in both)
        assert [p for _, p in lines] == sorted(p for _, p in lines) and len(lines) >= 9
    assert packed(df.selectExpr("date", "CAST(id AS string) AS id"), "date", "id") == packed(df, "date") == []
    path = f"{tmp_path}/sorted"
    write_sorted_parquet(df.repartition(3), path, "date", "id")
    assert as_set(read_parquet(spark, path)) == as_set(df)


def test_write_by_month_brings_a_month_together(spark, tmp_path):
    df = spark.range(1200).selectExpr("date_add(DATE'2020-01-01', CAST(id % 366 AS int)) AS day", "id")
    write_by_month(df.repartition(4), f"{tmp_path}/together", "day")
    stored = read_parquet(spark, f"{tmp_path}/together")
    assert len(stored.inputFiles()) == 12 and as_set(stored.select("day", "id")) == as_set(df)


def test_write_by_month_replaces_only_its_months(spark, rows, tmp_path):
    path = f"{tmp_path}/months"
    ddl = "day date, v int"
    write_by_month(rows(ddl, (date(2020, 1, 5), 1), (date(2020, 2, 5), 2)), path, "day")
    write_by_month(rows(ddl, (date(2020, 2, 6), 3)), path, "day")
    assert as_set(read_parquet(spark, path)) == [
        (date(2020, 1, 5), 1, 2020, 1),
        (date(2020, 2, 6), 3, 2020, 2),
    ]


@pytest.mark.parametrize(
    "dates, separator, label",
    [
        ("2020/01/*", "/", "2020/01"),
        ("2020/1*/*", "/", "2020"),
        ("2020/01/02", "/", "2020/01/02"),
        ("2020-12-11", "-", "2020/12/11"),
    ],
)
def test_stage_label(dates, separator, label):
    assert stage_label(dates, separator) == label


def test_compact(spark, tmp_path):
    path = f"{tmp_path}/many"
    df = spark.range(150).repartition(10)
    write_parquet(df, path)
    target = compact(spark, path + "/", files=2)
    assert target == path + "_group"
    assert len(list((tmp_path / "many_group").glob("*.parquet"))) == 2
    assert as_set(read_parquet(spark, target)) == as_set(df)
    assert read_parquet(spark, path).count() == 150


def test_compact_gives_a_task_no_more_than_told(spark, tmp_path):
    path = f"{tmp_path}/many"
    write_parquet(spark.range(40_000).repartition(10), path)
    size = sum(f.stat().st_size for f in (tmp_path / "many").glob("*.parquet"))
    target = compact(spark, path, files=2, most_bytes=size // 6)
    assert len(list((tmp_path / "many_group").glob("*.parquet"))) in (6, 7)
    assert as_set(read_parquet(spark, target)) == [(i,) for i in range(40_000)]


def test_compact_refuses_small_input(spark, tmp_path):
    path = f"{tmp_path}/few"
    write_parquet(spark.range(99), path)
    with pytest.raises(ValueError):
        compact(spark, path, files=1)
    assert not (tmp_path / "few_group").exists()
    assert compact(spark, path, files=1, min_rows=99)


def test_quality(rows):
    replicas = rows(
        "max_time string, rep_size double, br_user_group_id int",
        ("20201126", 1.0, 42),
        ("20201126", 2.0, 18),
        ("20201126", 4.0, None),
        ("20201126", None, 42),
        ("20201127", 8.0, 42),
    )
    assert dataset_sizes_check(replicas, "2020-11-26").first()[:] == (7.0, 3.0, 1.0)
    assert null_counts(replicas).first().asDict() == {
        "max_time": 0,
        "rep_size": 1,
        "br_user_group_id": 1,
    }
    names = ["allSize", "allOpsSize", "anaOpsSize", "oldAllSize", "oldAllOpsSize", "oldAnaOpsSize"]
    sizes = rows(", ".join(f"{n}90 double" for n in names), (1.0,) * 6, (2.0,) * 6, (None,) * 6)
    assert set(window_totals(sizes, (90,)).first()[:]) == {3.0}


def test_shared_dir_follows_the_cluster_setting(spark):
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_shared_dir_needs_the_setting():
    class Unset:
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir is not set"):
        shared_dir(Unset, "x")


def test_stage_label_of_wildcards_only():
    with pytest.raises(ValueError, match="names no directory"):
        stage_label("*/*")


@pytest.mark.parametrize(
    "text",
    ['{"/a/b/C": 3', '{"/a/b/C": 4.5}', '{"/a/b/C": "7"}', '{"/a/b/C": 3} {"/d/e/F": 4}', " ", "[1]"],
)
def test_overrides_fail_on_what_is_not_one_object(spark, tmp_path, text):
    (tmp_path / "overrides.json").write_text(text)
    with pytest.raises(Exception, match="not one JSON object"):
        read_overrides(spark, str(tmp_path)).collect()


def test_overrides_fail_on_too_large_a_number(spark, tmp_path):
    (tmp_path / "overrides.json").write_text('{"/a/b/C": 99999999999}')
    with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE|FAILFAST|malformed"):
        read_overrides(spark, str(tmp_path)).collect()


def test_sorted_rows_are_shuffled_a_slice_at_a_time(spark, tmp_path, monkeypatch):
    """The shuffles that made the rows stayed on disk beside the shuffle of all rows."""
    monkeypatch.setattr(writers, "SLICED_BYTES", 0, raising=False)
    path, made = f"{tmp_path}/sorted", spark.range(60_000).selectExpr("id % 500 AS a", "id").groupBy("a").agg(F.max("id").alias("m"))
    df = made.selectExpr("explode(sequence(1, 400)) AS n", "a AS dataset_id", "m * 3.5 AS size")
    df = df.selectExpr("CASE WHEN n < 399 THEN date_add(DATE'2020-01-01', n) END AS date", "dataset_id", "size")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    had, there = shuffles(), set(tmp_path.iterdir())
    jobs, ranged = [], type(df).repartitionByRange

    def spy(self, *keys):
        for _ in range(40):  # files go in the background
            if not (left := shuffles() - had):
                break
            time.sleep(0.25)
        jobs.append((len(left), self.count()))
        return ranged(self, *keys)

    monkeypatch.setattr(type(df), "repartitionByRange", spy)
    write_sorted_parquet(df, path, "date", "dataset_id")
    assert [left for left, _ in jobs] == [0] * len(jobs), "files of other shuffles lie beside that of a slice"
    assert len(jobs) == 3 and max(rows for _, rows in jobs) < 0.5 * df.count()
    stored = read_parquet(spark, path)
    assert as_set(stored) == as_set(df)
    within = stored.groupBy(F.input_file_name().alias("f")).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spans = sorted((r.lo or date.min, r.hi or date.min) for r in within.collect())
    assert all(hi <= lo for (_, hi), (lo, _) in zip(spans, spans[1:]))
    assert {x for x in tmp_path.iterdir()} - there == {tmp_path / "sorted"}


def test_sorted_slices_of_any_key(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "SLICED_BYTES", 0, raising=False)
    path = f"{tmp_path}/sorted"
    for ddl, some in (
        ("k int, v int", [(None, 1), (None, None), (3, 1), (3, 1), (-5, 2)] * 40),
        ("k int, v int", [(7, i) for i in range(90)]),
        ("k int, v int", [(None, 1)]),
        ("k int, v int", []),
        ("k string, v int", [("b", 1), (None, 2), ("a", 1)]),
        ("k double, v int", [(float("nan"), 1), (None, 2), (0.5, 1)]),
    ):
        df = rows(ddl, *some)
        write_sorted_parquet(df.repartition(3), path, "k", "v")
        stored = read_parquet(spark, path)
        assert sorted(tuple(map(str, r)) for r in stored.collect()) == sorted(tuple(map(str, r)) for r in df.collect())
        assert stored.dtypes == df.dtypes
    write_sorted_parquet(read_parquet(spark, path).limit(1), path, "k", "v")
    assert read_parquet(spark, path).count() == 1
