"""Rolling popularity: how much of the disk holds data read lately, day by day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.days import as_date, date_literal
from tidemark.functions.metrics import ROLLING_WINDOWS, ratio
from tidemark.sources.spine import SPINE_END, SPINE_START


def rolling_popularity(
    reads: DataFrame,
    daily: DataFrame,
    windows: Sequence[int] = ROLLING_WINDOWS,
    start: str | date = SPINE_START,
    end: str | date = SPINE_END,
) -> DataFrame:
    """Rows (window, date, fraction, size): operations bytes on disk that day and the fraction of
    them in datasets read on that day or up to ``window`` days before.

    ``reads`` are merged reads: a row is a read whatever its fraction. ``daily`` holds one row per
    (date, dataset). A day on which nothing on disk had been read is left out.

    Whether a dataset counts depends only on its last read day so far. Daily sizes and read days
    are stacked and put in order per dataset - at most two rows per calendar day - and that last
    day is carried forward; it serves every window and the daily total in one pass, with no join
    and no expansion of reads into days.
    """
    first, last = date_literal(start), date_literal(end)
    on_disk = daily.where(F.col("date").between(first, last)).select(
        "dataset_id",
        "date",
        F.col("allOpsSize").alias("bytes"),
        F.lit(None).cast("date").alias("read_day"),
    )
    read_days = (
        reads.select(F.col("d_dataset_id").alias("dataset_id"), as_date(reads, "day").alias("date"))
        .where(F.col("dataset_id").isNotNull())
        .where(F.col("date").between(F.date_sub(first, max(windows)), last))
        .distinct()
        .select(
            "dataset_id",
            "date",
            F.lit(None).cast(daily.schema["allOpsSize"].dataType).alias("bytes"),
            F.col("date").alias("read_day"),
        )
    )
    so_far = (
        Window.partitionBy("dataset_id")
        .orderBy("date")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    idle = F.datediff("date", F.max("read_day").over(so_far))
    aged = (
        on_disk.unionByName(read_days)
        .select("date", "bytes", "read_day", idle.alias("idle"))
        .where(F.col("read_day").isNull())
    )
    totals = aged.groupBy("date").agg(
        F.sum("bytes").alias("size"),
        *[F.sum(F.when(F.col("idle") <= w, F.col("bytes"))).alias(f"read{w}") for w in windows],
        *[F.count_if(F.col("idle") <= w).alias(f"n{w}") for w in windows],
    )
    per_window = F.array(
        *[
            F.struct(
                F.lit(w).alias("window"),
                F.col(f"read{w}").alias("read"),
                F.col(f"n{w}").alias("n"),
            )
            for w in windows
        ]
    )
    return (
        totals.select("date", "size", F.inline(per_window))
        .where(F.col("n") > 0)
        .select("window", "date", ratio(F.col("read"), F.col("size")).alias("fraction"), "size")
    )
