"""Reads of all sources per dataset and day, and binned over trailing windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.days import as_date, date_literal
from tidemark.functions.metrics import READ_METRICS, WINDOWS, read_bin, windowed


def merge_reads(cmssw: DataFrame, xrootd: DataFrame, classads: DataFrame) -> DataFrame:
    """Fraction read per (dataset, day) by source, and the greatest of the three.

    A row of one source matches a row of another on dataset and day. The sources are stacked and
    grouped once - one shuffle, combined on the map side - instead of grouped three times and
    joined twice. A NULL key never matches, so there the source joins the grouping key.
    """
    sources = dict(zip(READ_METRICS[1:], (cmssw, xrootd, classads)))
    stacked = reduce(
        DataFrame.unionByName,
        [
            daily.select("d_dataset_id", "day", "fract_read", F.lit(metric).alias("source"))
            for metric, daily in sources.items()
        ],
    )
    unmatched = F.when(F.col("d_dataset_id").isNull() | F.col("day").isNull(), F.col("source"))
    merged = (
        stacked.groupBy("d_dataset_id", "day", unmatched.alias("unmatched"))
        .agg(
            *[
                F.sum(F.when(F.col("source") == metric, F.col("fract_read"))).alias(metric)
                for metric in sources
            ]
        )
        .drop("unmatched")
    )
    return merged.withColumn("fract_read", F.greatest(*sources))


def read_windows(
    merged: DataFrame,
    end_date: str | date = "2020-11-24",
    windows: Sequence[int] = WINDOWS,
    include_future: bool = True,
) -> DataFrame:
    """Read bin per dataset, metric and trailing window of days up to ``end_date``.

    Days after ``end_date`` count in every window unless ``include_future`` is off.
    """
    prior = F.datediff(date_literal(end_date), as_date(merged, "day"))
    since = "" if include_future else "AND days_prior >= 0"
    sums = (
        merged.withColumn("days_prior", prior)
        .groupBy("d_dataset_id")
        .agg(
            *[
                F.expr(
                    f"sum(CASE WHEN days_prior < {window} {since} THEN {metric} ELSE 0 END) "
                    f"AS {metric}{window}"
                )
                for window in windows
                for metric in READ_METRICS
            ]
        )
    )
    return sums.select(
        "d_dataset_id",
        *[read_bin(F.col(name)).alias(name) for name in windowed(READ_METRICS, windows)],
    )
