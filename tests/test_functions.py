from datetime import date

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions.days import as_date, day_key, epoch_day
from tidemark.functions.metrics import ops_size, ratio, read_bin, windowed
from tidemark.sources.spine import date_spine, days_between, spine_over

PATHS = {
    "/A/Run2018A-12Nov2019-v1/AOD": ("AOD", "Run2018A-12Nov2019", "Run2018A-12Nov2019", "Run2018A-12Nov2019"),
    "/A/RunIIAutumn18-102X_v15_ext1-v2/AODSIM": (
        "AODSIM",
        "RunIIAutumn18",
        "RunIIAutumn18-102X_v15",
        "RunIIAutumn18-102X_v15_ext1",
    ),
    "/A/RunIISummer16-94X_v3-v1/RAW": ("RAW", "RunIISummer16", "RunIISummer16-94X_v3", "RunIISummer16-94X"),
    "/A/CMSSW_10_2_0-102X-v1/RAW": ("RAW", "CMSSW_10", "CMSSW_10_2_0-102X", "CMSSW_10_2_0-102X"),
    "/A/Old/RAW": ("RAW", "Old", None, "Old"),
    "/A/B-v1/RAW": ("RAW", "B", "B-B", "B"),
    "/A/a-b-c-d-v3/GEN-SIM/9": ("GEN-SIM", "a", "a-d", "a-b-c-d"),
    "/A/x_v1_v2_v3_v4-v9/RAW": ("RAW", "x_v1_v2_v3_v4", "x_v1_v2_v3_v4-x_v1_v2_v3_v4", "x_v1"),
    "/A": (None, "", None, None),
    None: (None, None, None, None),
}


def test_names(rows):
    df = rows("path string", *[(p,) for p in PATHS])
    path = F.col("path")
    got = df.select(
        path,
        names.tier(path),
        names.input_campaign(path),
        names.tape_campaign(path),
        names.unused_campaign(path),
    ).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == PATHS


@pytest.mark.parametrize(
    "tier, expected",
    [
        ("AOD", {"All", "sAODs", "AODs"}),
        ("AODSIM", {"All", "sAODs", "AODs"}),
        ("MINIAODSIM", {"All", "sAODs", "sMINIAODs"}),
        ("NANOAOD", {"All", "sAODs"}),
        ("RAW", {"All", "notsAODs"}),
        (None, {"All"}),
    ],
)
def test_tier_categories(rows, tier, expected):
    df = rows("tier string", (tier,))
    row = df.select(*[test.alias(name) for name, test in names.tier_categories().items()]).first()
    assert {name for name, member in row.asDict().items() if member} == expected


def test_tally_day_of_path(rows):
    df = rows(
        "path string",
        ("hdfs://a/rucio/2020-12-11/replicas/part-0.avro",),
        ("/rucio/2019-01-01/rucio/2020-02-03/x",),
        ("/elsewhere/file",),
        (None,),
    )
    got = [r[0] for r in df.select(names.tally_day_of_path(F.col("path"))).collect()]
    assert got == [date(2020, 12, 11), date(2020, 2, 3), None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_epoch_day_ignores_session_zone(spark, rows, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = rows("s bigint", (0,), (86399,), (86400,), (1606262399,), (None,))
        got = df.select(
            day_key(epoch_day(F.col("s"))), day_key(epoch_day(F.col("s") * 1000 + 999, "ms"))
        )
        days = ["19700101", "19700101", "19700102", "20201124", None]
        assert [tuple(r) for r in got.collect()] == [(d, d) for d in days]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_epoch_day_of_fractional_seconds(rows):
    df = rows("s double", (1606262399.9,))
    assert df.select(epoch_day(F.col("s"))).first()[0] == date(2020, 11, 24)


def test_as_date(rows):
    df = rows("a string, b date", ("20200229", date(2020, 2, 29)), ("20200230", None), (None, None))
    got = df.select(as_date(df, "a"), as_date(df, "b")).collect()
    assert [tuple(r) for r in got] == [(date(2020, 2, 29),) * 2, (None, None), (None, None)]


def test_read_bin(rows):
    cases = {
        None: 0,
        0.0: 0,
        0.01: 1,
        1.0: 1,
        1.49: 1,
        1.5: 1,
        1.99: 1,
        2.0: 2,
        14.99: 14,
        15.0: 15,
        15.01: 15,
        1e30: 15,
        -0.5: 0,
        -2.7: -2,
        float("inf"): 15,
    }
    df = rows("f double", *[(f,) for f in cases])
    got = df.select("f", read_bin(F.col("f")).alias("bin"))
    assert dict(map(tuple, got.collect())) == cases
    assert got.schema["bin"].dataType.simpleString() == "bigint"
    assert rows("f double", (float("nan"),)).select(read_bin(F.col("f"))).first()[0] == 15


def test_group_sizes_and_ratio(rows):
    df = rows("g int, s double", (42, 5.0), (18, 5.0), (19, 5.0), (7, 5.0), (None, 5.0), (42, None))
    got = [r[0] for r in df.select(ops_size(F.col("s"), F.col("g"))).collect()]
    assert got == [5.0, 5.0, 5.0, 0.0, 0.0, None]
    df = rows("a bigint, b double", (1, 4.0), (1, 0.0), (None, 2.0), (1, None))
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.25, None, None, None]


def test_windowed():
    assert windowed(("a", "b"), (1, 2)) == ["a1", "b1", "a2", "b2"]


def test_spine(spark, rows):
    default = date_spine(spark)
    assert default.count() == 732
    assert default.agg(F.min("date"), F.max("date")).first() == (date(2019, 1, 1), date(2021, 1, 1))
    assert date_spine(spark, "2020-02-28", date(2020, 3, 1)).count() == 3
    assert date_spine(spark, "2020-02-28", "2020-02-27").count() == 0
    df = rows("d date", (date(2020, 1, 3),), (date(2020, 1, 1),))
    assert as_set(spine_over(df, "d")) == [(date(2020, 1, d),) for d in (1, 2, 3)]


def test_days_between_backwards_is_empty(rows):
    df = rows("a date, b date", (date(2020, 1, 3), date(2020, 1, 1)))
    assert df.select(days_between(F.col("a"), F.col("b"))).first()[0] == []


@pytest.mark.parametrize("seconds", [1.6e12, 1e13, 2e14, 1.6e18, -1e12, float("nan"), None])
def test_epoch_day_outside_the_calendar_is_null(rows, seconds):
    df = rows("s double", (seconds,))
    assert df.select(day_key(epoch_day(F.col("s")))).first()[0] is None
    if seconds is not None and seconds == seconds:
        whole = rows("s bigint", (int(seconds),))
        assert whole.select(day_key(epoch_day(F.col("s")))).first()[0] is None


def test_epoch_day_at_the_calendar_ends(rows):
    df = rows("s bigint", (-62135596800,), (253402300799,), (253402300800,))
    assert [r[0] for r in df.select(epoch_day(F.col("s"))).collect()] == [
        date(1, 1, 1),
        date(9999, 12, 31),
        None,
    ]
