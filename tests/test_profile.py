"""Sketches against exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile


@pytest.fixture(scope="module")
def values(spark):
    """30,000 rows of 30 days; a third of all rows on one day."""
    rows = spark.range(30_000)
    day = F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 30).cast("int"))
    return rows.select(
        day.alias("day"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(9000))).alias("user"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) ** 2).alias("size"),
    ).cache()


def test_merged_days_are_close_to_exact(values):
    daily = profile.sketched(values, ["day"], ["user"], ["size"])
    (merged,) = profile.estimates(profile.merged_sketches(daily), (0.1, 0.5, 0.99)).collect()
    rows = values.toPandas()
    assert merged.n == 30_000
    assert merged.distinct_user == pytest.approx(rows["user"].nunique(), rel=0.06)
    for rank, value in zip((0.1, 0.5, 0.99), merged.quantiles_size, strict=True):
        assert np.mean(rows["size"] <= value) == pytest.approx(rank, abs=0.03)


def test_any_range_of_stored_days(spark, values, tmp_path):
    profile.sketched(values, ["day"], ["user"], ["size"]).write.parquet(f"{tmp_path}/daily")
    daily = spark.read.parquet(f"{tmp_path}/daily")
    for first, last in ((0, 3), (7, 7), (5, 29)):
        told = profile.estimates(profile.merged_sketches(daily.where(F.col("day").between(first, last)))).first()
        rows = values.where(F.col("day").between(first, last)).toPandas()
        assert told.n == len(rows)
        assert told.distinct_user == pytest.approx(rows["user"].nunique(), rel=0.06)
        assert np.mean(rows["size"] <= told.quantiles_size[1]) == pytest.approx(0.5, abs=0.03)


def test_merging_in_steps_is_merging_at_once(values):
    daily = profile.sketched(values, ["day"], ["user"])
    weeks = profile.merged_sketches(daily, [F.floor(F.col("day") / 7).alias("week")])
    one, two = (profile.estimates(profile.merged_sketches(x)).first() for x in (weeks, daily))
    assert one == two


def test_empty_and_null(rows):
    empty = rows("day int, user bigint, size double")
    assert profile.sketched(empty, ["day"], ["user"], ["size"]).count() == 0
    nulls = rows("day int, user bigint, size double", (1, None, 2.0), (1, 5, 4.0))
    told = profile.estimates(profile.sketched(nulls, ["day"], ["user"], ["size"])).first()
    assert (told.n, told.distinct_user) == (2, 1)
