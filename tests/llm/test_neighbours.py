"""Nearest neighbours: odd tables, and copies that follow the window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours

CLASHING = ("row", "place", "curve", "block", "span", "vec", "norm", "key", "rank", "score", "size")


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    return df.withColumns({name: F.lit("clash") for name in CLASHING})


def test_clashing_columns_and_small_tables(spark):
    pick = np.random.default_rng(1)
    for n in (1, 2, 15, 21, 45):
        vectors = pick.standard_normal((n, 5))
        got = neighbours.nearest(table(spark, vectors)).toPandas()
        assert list(got.columns) == ["query_id", "rank", "vec_id", "score"]
        want = {q: min(20, n - 1) for q in range(0, n, 20)}
        assert got.groupby("query_id").size().to_dict() == {q: k for q, k in want.items() if k}


def test_one_dimensional_and_clustered_vectors(spark):
    """Even where curves hold all in one cell every query finds as many as it should."""
    line = [[1.0, 0.001 * (i % 3)] for i in range(300)]
    got = neighbours.nearest(table(spark, line)).toPandas()
    assert set(got.groupby("query_id").size()) == {20}


def test_equal_scores_and_repeated_rows(spark):
    vectors = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 5
    df = table(spark, vectors)
    got = neighbours.nearest(df).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}
    twice = df.unionByName(df.filter("vec_id = 0"))
    got = neighbours.nearest(twice).filter("query_id = 0").collect()
    assert len(got) == 40 and sum(r.vec_id == 0 for r in got) == 2


def test_tables_without_vectors(spark):
    empty = table(spark, [[1.0]]).limit(0)
    assert neighbours.nearest(empty).count() == 0
    assert neighbours.nearest(table(spark, [None, [0.0], [float("inf")]])).count() == 0


@pytest.mark.parametrize("count", [20_000, 80_000])
def test_copies_follow_the_window(spark, count, monkeypatch):
    """Four times as many vectors are copied as often each."""
    monkeypatch.setattr(neighbours, "BLOCK", 256)
    monkeypatch.setattr(neighbours, "QUERY_CHUNK", 64)
    rows = spark.range(count).selectExpr("id AS row", "id AS vec_id", "CAST('' AS BINARY) AS vec")
    places = rows.select("row", F.lit(0).alias("curve"), F.col("row").alias("place"))
    window = 1000
    members, visits = neighbours._met(places, rows, "vec_id % 20 = 0", window, count)
    copies = members.groupBy("row").count().agg(F.max("count"), F.avg("count")).first()
    assert copies[0] <= 2 * window / 1280 + 3
    assert visits.groupBy("row").count().agg(F.max("count")).first()[0] <= 2 * window / 256 + 2
    # every query meets every vector within its window, once
    met = members.alias("m").join(visits.alias("q"), ["curve", "block", "span"])
    met = met.filter("abs(m.place - q.place) <= 1000").groupBy("q.row").agg(F.count("*").alias("n"), F.count_distinct("m.row").alias("d"))
    edge = F.least("row", F.lit(window)) + F.least(F.lit(count - 1) - F.col("row"), F.lit(window)) + 1
    assert met.filter((F.col("n") != edge) | (F.col("d") != edge)).isEmpty() and met.count() == count // 20


def test_a_task_holds_few_scores_at_once(spark, monkeypatch):
    """However many queries meet a block: their scores, and what is made of them, filled the task."""
    scores = neighbours._scores

    def spy(queries, vectors, allowed, k):
        if len(queries) * len(vectors) > 1 << 20:
            raise ValueError(f"{len(queries)} x {len(vectors)} scores at once")
        return scores(queries, vectors, allowed, k)

    monkeypatch.setattr(neighbours, "_scores", spy)
    vectors = np.random.default_rng(2).standard_normal((2500, 8))
    got = neighbours.nearest(table(spark, vectors), "true").groupBy("query_id").count()
    assert got.count() == 2500 and got.filter("count <> 20").isEmpty()


def test_what_is_merged_together_does_not_grow_with_the_window(spark, monkeypatch):
    """A query that meets more blocks brings more to merge, so that fewer queries are merged together."""
    grouped, apply = type(spark.range(1).groupBy("id")), type(spark.range(1).groupBy("id")).applyInArrow

    def spy(self, func, schema):
        def bounded(found):
            held = sum(len(x.as_py()) for x in found["found"])
            if held > 24 << 20:
                raise ValueError(f"{held} bytes to merge")
            return func(found)

        return apply(self, bounded if "rank" in schema else func, schema)

    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "_window", lambda *a: 3000)
    monkeypatch.setattr(grouped, "applyInArrow", spy)
    vectors = np.random.default_rng(3).standard_normal((3000, 8)).astype(np.float32).astype(float)
    got = neighbours.nearest(table(spark, vectors), "vec_id % 10 = 0").toPandas()
    for q in (0, 10, 2990):  # all vectors lie within the window
        score = vectors @ vectors[q]
        score[q] = -np.inf
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == np.lexsort((np.arange(3000), -score))[:20].tolist()
    assert len(got) == 300 * 20
