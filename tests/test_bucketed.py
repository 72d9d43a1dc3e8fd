"""Bucketed tables with a manifest."""

import pytest
from conftest import as_set

from checks import queries
from tidemark.sinks import bucketed
from tidemark.sinks.bucketed import LayoutError


def table(spark, rows):
    return spark.range(rows).selectExpr("CONCAT('f', id % 97) AS name", "id AS v")


def test_rewrites_in_one_session(spark, tmp_path):
    path = f"{tmp_path}/it's a path"
    bucketed.write_bucketed_table(table(spark, 500), path, "name", 4)
    first = bucketed.read_bucketed_table(spark, path)
    assert as_set(first) == as_set(table(spark, 500))
    bucketed.write_bucketed_table(table(spark, 300), path, "name", 16)
    assert as_set(bucketed.read_bucketed_table(spark, path, "name", 16)) == as_set(table(spark, 300))
    assert first.count() == 500  # a job that began before goes on with what it began with
    assert [w.buckets for w in bucketed.layouts(spark, path)] == [16, 4]


def test_buckets_are_known_to_the_planner(spark, tmp_path):
    path = f"{tmp_path}/b"
    bucketed.write_bucketed_table(table(spark, 500), path, "name", 4)
    for _ in range(2):
        read = bucketed.read_bucketed_table(spark, path)
        plan = read.groupBy("name").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_another_session_knows_the_buckets(spark, tmp_path):
    path = f"{tmp_path}/b"
    layout = bucketed.write_bucketed_table(table(spark, 500), path, "name", 4)
    spark.sql(f"DROP TABLE {layout.table}")
    read = bucketed.read_bucketed_table(spark, path)
    assert as_set(read) == as_set(table(spark, 500))
    assert "Exchange" not in read.groupBy("name").count()._jdf.queryExecution().executedPlan().toString()


def test_refusals(spark, tmp_path):
    path = f"{tmp_path}/b"
    with pytest.raises(LayoutError, match="manifest"):
        bucketed.read_bucketed_table(spark, path)
    bucketed.write_bucketed_table(table(spark, 50), path, "name", 4)
    with pytest.raises(LayoutError, match="written with 4 buckets, read with 8"):
        bucketed.read_bucketed_table(spark, path, buckets=8)
    with pytest.raises(LayoutError, match="bucketed by name, not by v"):
        bucketed.read_bucketed_table(spark, path, key="v")
    with pytest.raises(LayoutError, match="v is bigint, not string"):
        bucketed.read_bucketed_table(spark, path, schema="name STRING, v STRING")
    with pytest.raises(LayoutError, match="w is None"):
        bucketed.read_bucketed_table(spark, path, schema="w INT")
    assert bucketed.read_bucketed_table(spark, path, "name", 4, "v BIGINT").count() == 50


def test_expire_keeps_the_newest(spark, tmp_path):
    path = f"{tmp_path}/b"
    written = [bucketed.write_bucketed_table(table(spark, n), path, "name", 2) for n in (10, 20, 30)]
    assert bucketed.expire(spark, path) == [written[0].data]
    assert bucketed.expire(spark, path) == []
    assert bucketed.read_bucketed_table(spark, path).count() == 30
    with pytest.raises(ValueError):
        bucketed.expire(spark, path, keep=0)


def test_check_finds_lost_doubled_and_misplaced_rows(spark, tmp_path):
    path = f"{tmp_path}/b"
    layout = bucketed.write_bucketed_table(table(spark, 200), path, "name", 4)
    bucketed.check_buckets(spark, path)
    report = bucketed.bucket_report(spark, path).collect()
    assert sum(r.n for r in report) == 200 and not any(r.misplaced or r.unsorted for r in report)
    files = sorted((tmp_path / "b" / f"data-{layout.id}").glob("part*.parquet"))
    content = files[0].read_bytes()
    files[0].unlink()
    with pytest.raises(LayoutError, match="rows, 200 written"):
        bucketed.check_buckets(spark, path)
    moved = files[1].with_name(files[1].name.replace("_00001", "_00003").replace("part-", "part-9"))
    moved.write_bytes(content)
    with pytest.raises(LayoutError, match="outside their bucket"):
        bucketed.check_buckets(spark, path)


@pytest.mark.parametrize("size, buckets", [(0, 1), (1, 1), (256 << 20, 1), ((256 << 20) + 1, 2), (3 << 30, 16), (100 << 40, 1 << 19)])
def test_buckets_follow_the_size(size, buckets):
    assert bucketed.buckets_for(size) == buckets


def test_input_bytes(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_bytes(b"x" * 1000)
    (tmp_path / "in" / "deep" / "b.csv").write_bytes(b"x" * 24)
    assert bucketed.input_bytes(spark, f"{tmp_path}/in") == 1024
    assert bucketed.input_bytes(spark, f"{tmp_path}/i*/*.csv") == 1000


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/b"
    bucketed.write_bucketed_table(table(spark, 0), path, "name", 4)
    assert bucketed.read_bucketed_table(spark, path).count() == 0
    bucketed.check_buckets(spark, path)


def test_query_takes_more_buckets_of_larger_tables(spark, monkeypatch):
    tables = "/root/testdata/sf0.001"
    size = bucketed.input_bytes(spark, f"{tables}/lineitem.parquet")
    wanted = as_set(queries.QUERIES["dataset_totals"](spark, tables))
    for most, buckets in ((size, 8), (size // 3, 32)):
        monkeypatch.setattr(queries, "BUCKET_INPUT", most)
        path, last = queries._bucketed_files(queries.Fixtures(spark, tables))
        assert [w.buckets for w in bucketed.layouts(spark, path)] == [buckets, buckets * 3 // 8] and last == buckets
        assert as_set(queries.QUERIES["dataset_totals_bucketed"](spark, tables)) == wanted
        assert queries.QUERIES["bucket_layout"](spark, tables).first()[1:] == (0, 0)
