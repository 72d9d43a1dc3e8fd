"""Physical plans: what is shuffled, what reaches the scan, and that nothing leaves the JVM."""

import re

import pytest

from checks.fixtures import Fixtures
from checks.queries import QUERIES
from tidemark.operators.access import file_read_tally, job_tally
from tidemark.operators.histogram import popularity_histogram
from tidemark.operators.occupancy import daily_size, replica_window_sizes
from tidemark.operators.popularity import top_unused
from tidemark.operators.reads import merge_reads, read_windows
from tidemark.operators.replicas import catalog_replicas_daily
from tidemark.operators.rolling import rolling_popularity

SF = "/root/testdata/sf0.001"

STAGED = {
    "log": "file_lfn string, end_time bigint, app_info string, site_name string, extra string",
    "files": "f_logical_file_name string, f_dataset_id int, f_file_size double, f_md5 string",
    "totals": "d_dataset string, d_dataset_id int, dsize double, devts bigint",
    "catalog": "d_dataset_id int, d_dataset string, extra string",
    "disk": "dataset_name string, replica_time_create string, node_name string, rep_size double, "
    "min_time date, max_time date, br_user_group_id int",
    "access": "d_dataset_id int, day string, fract_read double, site_name string",
    "merged": "d_dataset_id int, day string, fract_read double, cmssw_read double, "
    "xroot_read double, classad_read double",
    "replicas": "NAME string, RSE_ID string, SCOPE string, BYTES bigint, CREATED_AT bigint, "
    "filename string, extra string",
    "daily": "date date, dataset_id int, allOpsSize double",
}


@pytest.fixture(scope="module")
def stage(spark, tmp_path_factory):
    """Empty stages as files; joins planned as if every side were large."""
    root = tmp_path_factory.mktemp("stages")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    made = {}
    for name, ddl in STAGED.items():
        spark.createDataFrame([], ddl).write.parquet(f"{root}/{name}")
        made[name] = spark.read.parquet(f"{root}/{name}")
    yield made
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning")


def test_access_counts_records_before_the_join(stage):
    text = plan(file_read_tally(stage["log"], stage["files"], stage["totals"]))
    assert text.index("SortMergeJoin [file_lfn") < text.index("partial_count(1)")
    assert "StringStartsWith(file_lfn,/store/)" in text
    assert "f_md5" not in text and "extra" not in text


def test_tallies_are_not_sorted_to_meet_their_totals(stage, rows):
    """Totals are one row for each dataset; the daily rows, of which there are many more, pass them by."""
    text = plan(file_read_tally(stage["log"], stage["files"], stage["totals"]))
    assert "ShuffledHashJoin [f_dataset_id" in text and "SortMergeJoin [f_dataset_id" not in text
    jobs = rows(
        "DESIRED_CMSDataset string, Status string, RecordTime bigint, KEvents double, Site string, "
        "InputData string, CMS_SubmissionTool string"
    )
    text = plan(job_tally(jobs, stage["totals"]))
    assert "ShuffledHashJoin [dataset_name" in text and "SortMergeJoin" not in text


def test_daily_size_has_no_range_join(stage):
    text = plan(daily_size(stage["disk"], stage["catalog"]))
    assert "NestedLoop" not in text and "Cartesian" not in text
    # changes per (name, day), runs per name, catalogue; the join reuses the runs' partitioning
    assert shuffles(daily_size(stage["disk"], stage["catalog"])) == 3
    pushed = re.search(r"FileScan parquet \[dataset_name.*?PushedFilters: \[([^\n]*)", text).group(1)
    assert "LessThanOrEqual(min_time,2021-01-01)" in pushed
    assert "node_name" not in text


def test_window_sizes_group_once(stage):
    df = replica_window_sizes(stage["disk"], stage["catalog"])
    assert shuffles(df) == 2  # replicas and catalogue, both by name
    assert plan(df).count("FileScan") == 2


def test_reads_shuffle_once(stage):
    access = stage["access"]
    assert shuffles(merge_reads(access, access, access)) == 1
    assert shuffles(read_windows(stage["merged"])) == 1


def test_rolling_reads_each_stage_once(stage):
    df = rolling_popularity(stage["merged"], stage["daily"])
    text = plan(df)
    assert text.count("FileScan") == 2 and "Join" not in text
    assert shuffles(df) == 3  # distinct read days, per dataset, per date


def test_top_unused_never_sorts_everything(spark, stage):
    pop = spark.createDataFrame(
        [], "dataset_id int, fract_read180 bigint, allSize90 double, allSize180 double, allSize365 double"
    )
    assert "TakeOrderedAndProject(limit=5000" in plan(top_unused(pop, stage["catalog"]))


def test_histogram_groups_before_it_spreads(spark):
    text = plan(popularity_histogram(Fixtures(spark, SF).overridden()))
    assert text.count("partial_sum(oldAnaOpsSize") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_stay_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for operator in ("Python", "Pandas", "Cartesian", "BroadcastNestedLoop", "MapInArrow"):
        assert operator not in text, operator


def test_catalog_replicas_shuffle_the_replicas_once(stage):
    tally = catalog_replicas_daily(stage["replicas"], stage["files"])
    assert shuffles(tally) == 3
