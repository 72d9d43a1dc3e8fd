"""Joins with hot keys set apart."""

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from tidemark.operators import skew
from tidemark.sinks.bucketed import read_bucketed_table, write_bucketed_table


@pytest.fixture(scope="module")
def large(spark):
    """A third of the rows have one key, some none."""
    rows = spark.range(6000)
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE CONCAT('k', id % 2500) END")
    return rows.select(key.alias("key"), F.col("id").alias("n")).cache()


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.range(2000).selectExpr("CONCAT('k', id) AS key", "id AS v")
    more = spark.createDataFrame([("hot", -1), ("hot", -2), (None, -3)], "key string, v bigint")
    return rows.unionByName(more)


def test_hot_keys(large):
    assert [r.key for r in skew.hot_keys(large, ["key"]).collect()] == ["hot"]
    assert skew.hot_keys(large, ["key"], 2).collect() == []
    weighted = skew.hot_keys(large, ["key"], 50, F.when(F.col("n") == 7, 10_000).otherwise(1))
    assert {r.key for r in weighted.collect()} == {"hot", "k7"}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [20_000, 1])
def test_equals_the_plain_join(large, small, how, most, monkeypatch):
    monkeypatch.setattr(skew, "MOST_BROADCAST", most)
    assert as_set(skew.join_spread(large, small, ["key"], how)) == as_set(large.join(small, ["key"], how))


def test_without_hot_keys_and_without_rows(large, small):
    even = large.where("key != 'hot'")
    assert as_set(skew.join_spread(even, small, ["key"])) == as_set(even.join(small, ["key"]))
    assert skew.join_spread(large.limit(0), small, ["key"]).count() == 0
    with pytest.raises(ValueError):
        skew.join_spread(large, small, ["key"], "full")


def test_two_keys(large, small):
    one, two = (df.withColumn("other", F.lit(1)) for df in (large, small))
    keys = ["key", "other"]
    assert as_set(skew.join_spread(one, two, keys)) == as_set(one.join(two, keys))


def test_bucketed_side_is_not_shuffled(spark, large, small, tmp_path):
    """The cold rows meet the buckets, the hot ones stay where they are."""
    write_bucketed_table(small, f"{tmp_path}/small", "key", 4)
    large.write.parquet(f"{tmp_path}/large")
    logged = spark.read.parquet(f"{tmp_path}/large")
    stored = read_bucketed_table(spark, f"{tmp_path}/small", "key")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = skew.join_spread(logged, stored, ["key"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert plan.count("Exchange hashpartitioning") == 1  # the cold rows of the larger side
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" in plan
    assert as_set(joined) == as_set(large.join(small, ["key"]))
    # those that the shuffle deals out have no hot key
    cold = logged.join(F.broadcast(skew.hot_keys(logged, ["key"])), ["key"], "left_anti")
    assert cold.groupBy("key").count().where("key IS NOT NULL").agg(F.max("count")).first()[0] < 6
