from datetime import date, datetime, timezone

import pytest
from conftest import as_set

from tidemark.operators.replicas import (
    catalog_replicas_daily,
    catalogued,
    disk_replicas,
    replica_spans,
    tape_usage,
)

SNAPSHOTS = (
    "now_sec double, dataset_name string, dataset_id int, block_id int, block_bytes bigint, "
    "node_name string, br_user_group_id int, replica_time_create double"
)
SPANS = (
    "dataset_name string, dataset_id int, replica_time_create string, node_name string, "
    "rep_size double, min_time string, max_time string, br_user_group_id int"
)


def at(day, hour=0):
    return datetime(2020, 1, day, hour, tzinfo=timezone.utc).timestamp()


def test_replica_spans(rows):
    snapshots = rows(
        SNAPSHOTS,
        (at(1, 5), "d", 1, 10, 100, "T2_A", 42, at(1)),
        (at(2, 5), "d", 1, 10, 200, "T2_A", 42, at(1)),
        (at(9, 5), "d", 1, 10, 300, "T2_A", 42, at(1)),
        (at(1, 6), "d", 1, 11, 7, "T2_A", 42, at(1, 20)),
        (at(9, 6), "d", 1, 11, 7, "T2_A", 42, at(1, 20)),
        (at(1), "d", 1, 10, 50, "T2_B", None, at(1)),
        (at(1), "d", 1, 12, None, "T2_C", 42, at(1)),
    )
    assert as_set(replica_spans(snapshots)) == [
        ("d", 1, "20200101", "T2_A", 207.0, "20200101", "20200109", 42),
        ("d", 1, "20200101", "T2_B", 50.0, "20200101", "20200101", None),
        ("d", 1, "20200101", "T2_C", None, "20200101", "20200101", 42),
    ]


def spans(rows, *nodes, **fields):
    base = {"name": "/A/a-x-y-v1/RAW", "size": 1.0, "last": "20201121"}
    base.update(fields)
    return rows(
        SPANS, *[(base["name"], 1, "20200101", n, base["size"], "20200101", base["last"], 42) for n in nodes]
    )


def test_disk_replicas(rows):
    nodes = ["T3_US", "X_T2", "T1_Buffer", "T1_MSS", "T0_Export", "T2_CH", "T1_Disk", "TX", None]
    disk = disk_replicas(spans(rows, *nodes))
    assert {r.node_name for r in disk.collect()} == {"T2_CH", "T1_Disk", "TX"}
    assert (disk.first().min_time, disk.first().max_time) == (date(2020, 1, 1), date(2020, 11, 21))


def test_catalogued_takes_the_catalogue_id(rows):
    replicas = rows("dataset_name string, dataset_id int, n int", ("a", 5, 1), ("b", 6, 2), (None, 7, 3))
    catalog = rows("d_dataset_id int, d_dataset string, extra string", (50, "a", "x"), (60, "c", "y"))
    got = catalogued(replicas, catalog)
    assert got.columns == ["dataset_name", "n", "dataset_id"]
    assert as_set(got) == [("a", 1, 50)]


def test_tape_usage(rows):
    df = (
        spans(rows, "T1_MSS", "T0_MSS", "T2_CH", None)
        .union(spans(rows, "T1_MSS", name="/A/c-102X_ext1-v1/AOD", last="20191231"))
        .union(spans(rows, "T1_MSS", name="/A/Plain/AOD"))
        .union(spans(rows, "T1_MSS", last=None))
    )
    everything = [("AOD", None, 1.0), ("AOD", "c-102X", 1.0), ("RAW", "a-y", 2.0)]
    assert as_set(tape_usage(df)) == everything
    assert as_set(tape_usage(df.selectExpr(*[f"CAST({c} AS string) AS {c}" for c in df.columns]))) == everything
    recent = as_set(tape_usage(df, active_since="2020-11-20"))
    assert recent == [("AOD", None, 1.0), ("RAW", "a-y", 2.0)]
    assert as_set(tape_usage(df, active_since=date(2020, 11, 21))) == []


@pytest.mark.parametrize("copies", [1, 3])
def test_catalog_replicas_daily(rows, copies):
    path = "/x/rucio/2020-12-11/replicas/part-0.avro"
    replicas = rows(
        "RSE_ID string, BYTES bigint, NAME string, SCOPE string, CREATED_AT bigint, filename string",
        *[("r1", 5, "/store/a", "cms", 86_400_000 - 1, path)] * copies,
        ("r1", 7, "/store/b", "cms", 0, path),
        ("r2", 9, "/store/b", "cms", 86_400_000, path),
        ("r2", 9, "/store/none", "cms", 86_400_000, path),
    )
    files = rows("f_logical_file_name string, f_dataset_id int", ("/store/a", 1), ("/store/b", 1))
    assert as_set(catalog_replicas_daily(replicas, files)) == [
        ("r1", 1, "cms", "20201211", "19700101", 5 * copies + 7),
        ("r2", 1, "cms", "20201211", "19700102", 9),
    ]
