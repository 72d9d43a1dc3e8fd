"""Metric families: read metrics, size metrics, trailing windows and read bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and numbers that appear in the stage files and reports.
READ_METRICS = ("fract_read", "cmssw_read", "xroot_read", "classad_read")
SIZE_METRICS = (
    "allSize",
    "allOpsSize",
    "anaOpsSize",
    "oldAllSize",
    "oldAllOpsSize",
    "oldAnaOpsSize",
)
WINDOWS = (90, 180, 365)
ROLLING_WINDOWS = (30, 90, 180)
READ_BINS = 16
OPS_GROUPS = (42, 18, 19)
ANALYSIS_GROUP = 42


def windowed(metrics: Sequence[str], windows: Sequence[int] = WINDOWS) -> list[str]:
    """Column names ``<metric><window>`` of a metric family."""
    return [f"{metric}{window}" for window in windows for metric in metrics]


def read_bin(reads: Column) -> Column:
    """Bin 0..15 of how many times a dataset was read.

    NULL and 0 give 0, anything up to 1.5 gives 1, above 15 gives 15, else the whole part.
    Negative values keep their whole part; NaN, which Spark orders above all numbers, gives 15.
    """
    top = READ_BINS - 1
    return (
        F.when(reads > top, top)
        .when((reads < 0) | (reads >= 1.5), reads.cast("bigint"))
        .when(reads > 0, 1)
        .otherwise(0)
        .cast("bigint")
    )


def ops_size(size: Column, group: Column) -> Column:
    """Size where the replica belongs to an operations group, else 0."""
    return F.when(group.isin(*OPS_GROUPS), size).otherwise(F.lit(0))


def analysis_size(size: Column, group: Column) -> Column:
    """Size where the replica belongs to the analysis group, else 0."""
    return F.when(group == ANALYSIS_GROUP, size).otherwise(F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` in double; NULL where ``whole`` is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
