from datetime import date

import pytest
from conftest import as_set

from tidemark.functions.metrics import READ_METRICS, SIZE_METRICS, windowed
from tidemark.operators.histogram import popularity_histogram
from tidemark.operators.occupancy import daily_size, replica_window_sizes
from tidemark.operators.popularity import (
    apply_overrides,
    override_daily,
    popularity,
    resolve_overrides,
    top_unused,
    unused_by_campaign,
)
from tidemark.operators.reads import read_windows

SIZES = "dataset_id int, tier string, " + ", ".join(f"{n} double" for n in windowed(SIZE_METRICS))
BINS = "d_dataset_id int, " + ", ".join(f"{n} bigint" for n in windowed(READ_METRICS))
CATALOG = "d_dataset_id int, d_dataset string"


def sizes(rows, *ids):
    return rows(SIZES, *[(i, "RAW", *[float(i)] * 18) for i in ids])


def bins(rows, **by_id):
    return rows(BINS, *[(int(i[1:]), *[value] * 12) for i, value in by_id.items()])


def test_popularity_keeps_both_sides(rows):
    pop = popularity(sizes(rows, 1, 2), bins(rows, d2=5, d3=7))
    got = {r["dataset_id"]: r for r in pop.collect()}
    assert pop.columns == ["dataset_id", "tier", *windowed(SIZE_METRICS), *windowed(READ_METRICS)]
    assert {i: (r["allSize90"], r["tier"], r["fract_read90"]) for i, r in got.items()} == {
        1: (1.0, "RAW", 0),
        2: (2.0, "RAW", 5),
        3: (None, None, 7),
    }


def test_apply_overrides(rows):
    pop = popularity(sizes(rows, 1, 2), bins(rows, d2=5, d3=7))
    overrides = rows("d_dataset_id int, value int", (1, 20), (2, None), (2, 3), (9, 4))
    got = as_set(
        apply_overrides(pop, overrides).select(
            "dataset_id", "d_dataset_id", "fract_read90", "classad_read365", "allSize90"
        )
    )
    assert got == [
        (None, 9, 4, 4, None),
        (1, 1, 20, 20, 1.0),
        (2, 2, 3, 3, 2.0),
        (2, 2, 5, 5, 2.0),
        (3, None, 7, 7, None),
    ]


def test_resolve_overrides(rows):
    overrides = rows("dataset_name string, value int", ("a", 1), ("unknown", 2), (None, 3))
    assert as_set(resolve_overrides(overrides, rows(CATALOG, (7, "a"), (8, "b")))) == [(7, 1)]


def test_override_daily(rows):
    daily = rows("date string, dataset_id int, allOpsSize double", ("x", 1, 1.0), ("x", 2, 2.0), ("y", 1, None), ("y", 3, 8.0))
    overrides = rows("d_dataset_id int, value int", (1, 0), (2, 0))
    assert as_set(override_daily(daily, overrides)) == [("x", 3.0), ("y", None)]


def test_top_unused(rows):
    pop = popularity(sizes(rows, 1, 2, 3, 4, 5), bins(rows, d4=1, d6=0))
    catalog = rows(CATALOG, (1, "a"), (2, "b"), (4, "d"), (5, "e"), (6, "f"))
    names = [r["d_dataset"] for r in top_unused(pop, catalog).collect()]
    assert names == ["e", "b", "a", "f"]
    # the limit comes before the lookup: 3 is among the three largest but has no name
    assert [tuple(r) for r in top_unused(pop, catalog, k=3).collect()] == [
        ("e", 5.0, 5.0, 5.0),
        ("b", 2.0, 2.0, 2.0),
    ]


def test_top_unused_breaks_ties_by_id(rows):
    same = rows(SIZES, *[(i, "RAW", *[1.0] * 18) for i in (3, 1, 2)])
    pop = popularity(same, bins(rows, d9=9))
    catalog = rows(CATALOG, (1, "a"), (2, "b"), (3, "c"))
    assert [r["d_dataset"] for r in top_unused(pop, catalog, k=2).collect()] == ["a", "b"]


def test_unused_by_campaign(rows):
    unused = rows(
        "d_dataset string, allSize365 double",
        ("/A/camp_v1-v2/RAW", 2e12),
        ("/B/camp-v9/AOD", 1e12),
        ("/C/camp_v1_v2_v3-v1/AOD", None),
        ("/D/other/AOD", 5e11),
    )
    assert as_set(unused_by_campaign(unused)) == [("camp", 3.0), ("other", 0.5)]


def test_other_windows_run_through_every_step(rows):
    windows = (30, 60)
    replicas = rows(
        "dataset_name string, replica_time_create string, min_time string, max_time string, "
        "rep_size double, br_user_group_id int",
        ("/A/a-v1/AOD", "20190101", "20201101", "20201201", 6.0, 42),
        ("/B/b-v1/RAW", "20190101", "20201002", "20201201", 3.0, 7),
    )
    catalog = rows(CATALOG, (1, "/A/a-v1/AOD"), (2, "/B/b-v1/RAW"))
    merged = rows(
        "d_dataset_id int, day string, fract_read double, cmssw_read double, xroot_read double, "
        "classad_read double",
        (1, "20201015", 2.0, 2.0, None, None),
    )
    pop = popularity(
        replica_window_sizes(replicas, catalog, "2020-12-01", windows),
        read_windows(merged, "2020-12-01", windows),
        windows,
    )
    pop = apply_overrides(pop, rows("d_dataset_id int, value int"), windows)
    assert as_set(
        pop.select("dataset_id", "allSize30", "allSize60", "anaOpsSize60", "fract_read30", "fract_read60")
    ) == [(1, 6.0, 3.0, 3.0, 0, 2), (2, 3.0, 3.0, 0.0, 0, 0)]
    unused = top_unused(pop, catalog, window=60, windows=windows)
    assert as_set(unused) == [("/B/b-v1/RAW", 3.0, 3.0)]
    assert as_set(unused_by_campaign(unused, "allSize60")) == [("b", 3e-12)]
    cells = {r[0]: r[1:] for r in as_set(popularity_histogram(pop, windows))}
    assert len(cells) == 240
    assert cells["sums_allSize_cmssw_read_AODs_60"][2] == 3.0
    assert as_set(daily_size(replicas, catalog, "2020-12-01", "2020-12-31")) == [
        (date(2020, 12, 1), 1, 6.0),
        (date(2020, 12, 1), 2, 0.0),
    ]
