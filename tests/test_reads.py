import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from conftest import as_set

from tidemark.functions.metrics import READ_METRICS, WINDOWS, windowed
from tidemark.operators.reads import merge_reads, read_windows

DAILY = "d_dataset_id int, day string, fract_read double, site_name string"
MERGED = "d_dataset_id int, day string, cmssw_read double, xroot_read double, classad_read double, fract_read double"


def test_merge_reads(rows):
    cmssw = rows(
        DAILY,
        (1, "20200101", 0.5, "a"),
        (1, "20200101", 0.25, "b"),
        (2, "20200101", None, "a"),
        (3, None, 1.0, "a"),
        (None, "20200101", 1.0, "a"),
    )
    xrootd = rows(DAILY, (1, "20200101", 2.0, "a"), (1, "20200102", 1.0, "a"), (3, None, 4.0, "a"))
    classads = rows(DAILY, (1, "20200102", 3.0, "a"), (None, "20200101", 5.0, "a"))
    merged = merge_reads(cmssw, xrootd, classads)
    assert merged.columns == ["d_dataset_id", "day", *READ_METRICS[1:], "fract_read"]
    assert as_set(merged) == [
        (None, "20200101", None, None, 5.0, 5.0),
        (None, "20200101", 1.0, None, None, 1.0),
        (1, "20200101", 0.75, 2.0, None, 2.0),
        (1, "20200102", None, 1.0, 3.0, 3.0),
        (2, "20200101", None, None, None, None),
        (3, None, None, 4.0, None, 4.0),
        (3, None, 1.0, None, None, 1.0),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_reads_equals_full_joins(spark, rows, seed):
    """One stacked grouping against three groupings joined twice, NULL keys included."""
    rng = random.Random(seed)

    def source():
        return rows(
            DAILY,
            *[
                (
                    rng.choice([None, *range(6)]),
                    rng.choice([None, *[f"2020010{d}" for d in range(1, 8)]]),
                    rng.choice([None, 0.0, 0.5, 2.25]),
                    "s",
                )
                for _ in range(60)
            ],
        )

    sources = [source() for _ in range(3)]
    names = READ_METRICS[1:]
    for name, df in zip(names, sources):
        df.createOrReplaceTempView(name)
    grouped = [
        f"(SELECT d_dataset_id, day, sum(fract_read) AS {n} FROM {n} GROUP BY 1, 2)" for n in names
    ]
    expected = spark.sql(
        f"""SELECT d_dataset_id, day, {", ".join(names)}, greatest({", ".join(names)})
            FROM {grouped[0]} FULL JOIN {grouped[1]} USING (d_dataset_id, day)
            FULL JOIN {grouped[2]} USING (d_dataset_id, day)"""
    )
    assert as_set(merge_reads(*sources)) == as_set(expected)


def merged_row(dataset, day, *reads):
    return (dataset, day, *reads, max((r for r in reads if r is not None), default=None))


def test_read_windows(rows):
    df = rows(
        MERGED,
        merged_row(1, "20201124", 1.0, None, 20.0),
        merged_row(1, "20200827", 0.6, None, None),  # 89 days before
        merged_row(1, "20200826", 1.0, None, None),  # 90 days before
        merged_row(1, "20191126", 4.0, None, None),  # 364 days before
        merged_row(1, "20191125", 9.0, None, None),  # 365 days before
        merged_row(2, "20201201", 3.0, None, None),  # after the end
        merged_row(3, "20201124", None, None, None),
        merged_row(4, None, 5.0, None, None),
    )
    bins = {r["d_dataset_id"]: r.asDict() for r in read_windows(df).collect()}
    assert list(bins[1])[1:] == windowed(READ_METRICS)
    assert [bins[1][f"cmssw_read{w}"] for w in WINDOWS] == [2 - 1 + 0, 2, 6]
    assert [bins[1][f"classad_read{w}"] for w in WINDOWS] == [15, 15, 15]
    assert [bins[1][f"xroot_read{w}"] for w in WINDOWS] == [0, 0, 0]
    assert [bins[2][f"fract_read{w}"] for w in WINDOWS] == [3, 3, 3]
    assert set(list(bins[3].values())[1:]) == set(list(bins[4].values())[1:]) == {0}
    past = {r["d_dataset_id"]: r for r in read_windows(df, include_future=False).collect()}
    assert past[2]["fract_read365"] == 0
    assert past[1].asDict() == bins[1]


def test_read_windows_takes_dates(rows):
    df = rows(MERGED.replace("day string", "day date"), merged_row(1, date(2020, 11, 24), 2.0, 0.0, 0.0))
    assert read_windows(df, date(2020, 11, 24)).first()["cmssw_read90"] == 2


@pytest.mark.parametrize("seed", [5])
def test_read_windows_match_brute_force(rows, seed):
    rng = random.Random(seed)
    end = date(2020, 11, 24)
    data = [
        merged_row(
            rng.choice([1, 1, 2, 3]),
            (end - timedelta(days=rng.randint(-20, 420))).strftime("%Y%m%d"),
            *[rng.choice([None, 0.25, 1.5]) for _ in range(3)],
        )
        for _ in range(120)
    ]
    sums = defaultdict(float)
    for dataset, day, *reads in data:
        prior = (end - date(int(day[:4]), int(day[4:6]), int(day[6:]))).days
        for w in WINDOWS:
            for metric, read in zip((*READ_METRICS[1:], READ_METRICS[0]), reads):
                if prior < w:
                    sums[dataset, f"{metric}{w}"] += read or 0.0
    for row in read_windows(rows(MERGED, *data)).collect():
        for name in windowed(READ_METRICS):
            total = sums[row["d_dataset_id"], name]
            expected = 0 if total == 0 else 1 if total < 1.5 else 15 if total > 15 else int(total)
            assert row[name] == expected
