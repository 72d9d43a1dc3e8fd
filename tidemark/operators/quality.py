"""Sanity totals over stages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.days import as_date, date_literal
from tidemark.functions.metrics import SIZE_METRICS, WINDOWS, analysis_size, ops_size, windowed


def dataset_sizes_check(replicas: DataFrame, day: str | date) -> DataFrame:
    """Total, operations and analysis bytes of the replicas last seen on ``day``."""
    size, group = F.col("rep_size"), F.col("br_user_group_id")
    return replicas.where(as_date(replicas, "max_time") == date_literal(day)).agg(
        F.sum(size).alias("rep_size"),
        F.sum(ops_size(size, group)).alias("allOpsSize"),
        F.sum(analysis_size(size, group)).alias("anaOpsSize"),
    )


def window_totals(sizes: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Grand total of every window size."""
    return sizes.agg(*[F.sum(name).alias(name) for name in windowed(SIZE_METRICS, windows)])


def null_counts(df: DataFrame) -> DataFrame:
    """Number of NULLs per column, under the column's own name."""
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns])
