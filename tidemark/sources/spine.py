"""Date spine: one row per calendar day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.days import date_literal

# Default bounds of the reports, both ends included.
SPINE_START = "2019-01-01"
SPINE_END = "2021-01-01"


def days_between(first: Column, last: Column) -> Column:
    """Array of the days ``first..last``, both included; empty where ``last`` is before ``first``."""
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return F.when(first <= last, days).otherwise(F.array().cast("array<date>"))


def date_spine(
    spark: SparkSession, start: str | date = SPINE_START, end: str | date = SPINE_END
) -> DataFrame:
    """Rows ``date`` for every day of ``start..end``, both included."""
    return spark.range(1).select(
        F.explode(days_between(date_literal(start), date_literal(end))).alias("date")
    )


def spine_over(df: DataFrame, day: str) -> DataFrame:
    """Rows ``date`` for every day from the earliest to the latest ``day`` of ``df``."""
    bounds = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return bounds.select(F.explode(days_between(F.col("first"), F.col("last"))).alias("date"))
