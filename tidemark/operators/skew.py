"""Joins that stay spread out where a few keys hold much of the larger side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot that more than one in so many rows have; so there are fewer hot keys than that.
HOT_SHARE = 1000
#: Rows of the smaller side with hot keys that are sent to all tasks; above that they are dealt out by salt.
MOST_BROADCAST, SALTS = 20_000, 64


def hot_keys(rows: DataFrame, keys: list[str], share: int = HOT_SHARE, weight: Column | None = None) -> DataFrame:
    """The non-null values of ``keys`` that more than one in ``share`` of the rows have, counted over all rows.

    ``weight`` is what a row counts, one by default; negative weights are not allowed. There are fewer values
    than ``share``, so they are collected, and every use of the result sees the same ones.
    """
    times = F.sum(F.lit(1) if weight is None else weight)
    names = [F.col(f"`{k}`") for k in keys]
    whole = rows.agg(times).first()[0] or 0
    counted = rows.groupBy(*names).agg(times.alias("_rows"))
    known = reduce(lambda a, b: a & b, (c.isNotNull() for c in names))
    hot = counted.filter(known & (F.col("_rows") * share > whole)).select(*names)
    return rows.sparkSession.createDataFrame(hot.collect(), hot.schema)


def join_spread(
    large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", share: int = HOT_SHARE
) -> DataFrame:
    """``large`` joined to ``small`` on columns that both have; ``how`` is inner, left, left_semi or left_anti.

    Rows of ``large`` with hot keys are not shuffled: the few rows of ``small`` that have them are fetched and
    sent to all tasks. Should those be more than MOST_BROADCAST (a key may repeat in ``small``, too), they are
    copied SALTS times instead and met by salted rows. All others join by ``keys`` as they are, so that
    ``small`` may be bucketed by them. Null keys match nothing.

    ``large`` is read for the count and then twice; let it be a table or grouped rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot join {how!r} with hot keys set apart")
    hot = hot_keys(large, keys, share)
    if hot.isEmpty():
        return large.join(small, keys, how)
    hot = F.broadcast(hot)
    cold = large.join(hot, keys, "left_anti").join(small, keys, how)
    ours, theirs = large.join(hot, keys, "left_semi"), small.join(hot, keys, "left_semi")
    few = theirs.limit(MOST_BROADCAST + 1).collect()
    if len(few) <= MOST_BROADCAST:
        few = F.broadcast(large.sparkSession.createDataFrame(few, theirs.schema))
        return cold.unionByName(ours.join(few, keys, how))
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in large.columns)), F.lit(SALTS))
    copies = theirs.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    warm = ours.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")
    return cold.unionByName(warm)
