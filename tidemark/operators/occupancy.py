"""Disk occupied over time: per day and averaged over trailing windows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.days import as_date, date_literal
from tidemark.functions.metrics import SIZE_METRICS, WINDOWS, analysis_size, ops_size, windowed
from tidemark.functions.names import tier
from tidemark.sources.spine import SPINE_END, SPINE_START, days_between

# Sizes stored as double are summed as this type, so that what a running sum adds it can take away.
_EXACT_SIZE = "decimal(38,6)"


def daily_size(
    replicas: DataFrame,
    catalog: DataFrame,
    start: str | date = SPINE_START,
    end: str | date = SPINE_END,
    method: str = "sweep",
) -> DataFrame:
    """Operations bytes on disk per (date, dataset), for each day of ``start..end`` on which the
    dataset has a replica; both ends of a lifetime count. Days with replicas but no operations
    bytes stay, with 0.

    ``sweep`` (default) adds each replica on its first day and takes it away after its last; it
    shuffles two rows per replica at most and expands only finished per-dataset intervals.
    ``explode`` cuts replicas into months and writes each month out per day; what it shuffles are
    pieces, not days. Both work per dataset name and look up the catalogue id once the dataset's rows are few.
    """
    first, last = date_literal(start), date_literal(end)
    size_type = replicas.schema["rep_size"].dataType
    inexact = not isinstance(size_type, (T.DecimalType, T.IntegralType))
    size = F.col("rep_size").cast(_EXACT_SIZE) if inexact else F.col("rep_size")
    lifetimes = (
        replicas.select(
            "dataset_name",
            as_date(replicas, "min_time").alias("min_time"),
            as_date(replicas, "max_time").alias("max_time"),
            ops_size(size, F.col("br_user_group_id")).alias("size"),
        )
        .where((F.col("min_time") <= last) & (F.col("max_time") >= first))
        .where(F.col("min_time") <= F.col("max_time"))
        .select(
            "dataset_name",
            F.greatest("min_time", first).alias("lo"),
            F.least("max_time", last).alias("hi"),
            "size",
        )
    )
    per_day = {"sweep": _sweep, "explode": _explode_days}[method](lifetimes, last)
    ids = catalog.select("d_dataset", F.col("d_dataset_id").alias("dataset_id"))
    total = F.col("size").cast("double") if inexact else F.col("size")
    # no run of days is empty; plain explode would build every array twice, to test its size
    return per_day.join(ids, F.col("dataset_name") == F.col("d_dataset")).select(
        F.explode_outer("days").alias("date"), "dataset_id", total.alias("allOpsSize")
    )


def _sweep(lifetimes: DataFrame, last: Column) -> DataFrame:
    """(dataset_name, days, size): runs of days over which the dataset's size does not change."""
    known = F.when(F.col("size").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    steps = F.array(
        F.struct(
            F.col("lo").alias("day"),
            F.col("size").alias("size"),
            F.lit(1).alias("replicas"),
            known.alias("sized"),
        ),
        F.struct(
            F.date_add("hi", 1).alias("day"),
            (-F.col("size")).alias("size"),
            F.lit(-1).alias("replicas"),
            (-known).alias("sized"),
        ),
    )
    changes = (
        lifetimes.select("dataset_name", F.inline(steps))
        .where(F.col("day") <= last)
        .groupBy("dataset_name", "day")
        .agg(
            F.sum("size").alias("size"),
            F.sum("replicas").alias("replicas"),
            F.sum("sized").alias("sized"),
        )
    )
    # at most one row per dataset and calendar day is left, so no window group is large
    in_order = Window.partitionBy("dataset_name").orderBy("day")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = changes.select(
        "dataset_name",
        "day",
        F.lead("day").over(in_order).alias("next_change"),
        *[F.sum(name).over(so_far).alias(name) for name in ("size", "replicas", "sized")],
    )
    until = F.coalesce(F.date_sub("next_change", 1), last)
    return runs.where(F.col("replicas") > 0).select(
        "dataset_name",
        days_between(F.col("day"), until).alias("days"),
        F.when(F.col("sized") > 0, F.col("size")).alias("size"),
    )


def _explode_days(lifetimes: DataFrame, last: Column) -> DataFrame:
    """(dataset_name, days, size): days on which the same pieces lie, added up within their month.

    Equal pieces are added up first, so that a month has 496 of them at most, however many replicas.
    """
    kind = lifetimes.groupBy().agg(F.sum("size").alias("size")).schema["size"].dataType.simpleString()
    months = F.sequence(F.trunc("lo", "month"), F.col("hi"), F.expr("interval 1 month"))
    # no lifetime is empty; plain explode would build every array twice, to test its size
    pieces = lifetimes.select("dataset_name", "lo", "hi", "size", F.explode_outer(months).alias("month"))
    alike = (
        pieces.select(
            "dataset_name",
            "month",
            F.greatest("lo", "month").alias("lo"),
            F.least("hi", F.last_day("month")).alias("hi"),
            "size",
        )
        .groupBy("dataset_name", "month", "lo", "hi")
        .agg(F.sum("size").alias("size"))
    )
    held = alike.groupBy("dataset_name", "month").agg(F.collect_list(F.struct("lo", "hi", "size")).alias("pieces"))
    bounds = "array_sort(array_distinct(concat(pieces.lo, transform(pieces.hi, d -> date_add(d, 1)))))"
    between = "transform(slice(bounds, 1, size(bounds) - 1), (d, i) -> struct(d AS lo, date_sub(bounds[i + 1], 1) AS hi))"
    runs = held.select("dataset_name", "pieces", F.expr(bounds).alias("bounds"))
    runs = runs.select("dataset_name", "pieces", F.inline(F.expr(between)))
    on_days = F.expr("filter(pieces, p -> p.lo <= lo AND p.hi >= hi)")
    total = f"aggregate(there, CAST(NULL AS {kind}), (sum, p) -> CAST(coalesce(sum + p.size, sum, p.size) AS {kind}))"
    there = runs.select("dataset_name", "lo", "hi", on_days.alias("there")).where(F.size("there") > 0)
    return there.select(
        "dataset_name", days_between(F.col("lo"), F.col("hi")).alias("days"), F.expr(total).alias("size")
    )


def replica_window_sizes(
    replicas: DataFrame,
    catalog: DataFrame,
    end_date: str | date = "2021-01-01",
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """Time-weighted mean bytes on disk per dataset over the ``windows`` days up to ``end_date``.

    Three sizes per window - all replicas, operations groups, analysis group - and the same three
    (``old...``) for datasets first created more than the window ago. A replica's share of a window
    is the number of midnights it spans in it over the window's length, so a replica seen on a
    single day weighs nothing.

    A dataset's age is one value per dataset: the ``old`` sizes are the plain sums or 0, decided
    after grouping. All sums and the age come from one pass with one shuffle, and the catalogue
    is joined to the grouped result.
    """
    end = date_literal(end_date)
    size, group = F.col("rep_size"), F.col("br_user_group_id")
    if isinstance(replicas.schema["rep_size"].dataType, T.IntegralType):
        size = size.cast("decimal(20,0)")  # bytes times days outgrow a long
    aged = replicas.select(
        "dataset_name",
        as_date(replicas, "replica_time_create").alias("created"),
        F.datediff(end, as_date(replicas, "min_time")).alias("min_age"),
        F.datediff(end, as_date(replicas, "max_time")).alias("max_age"),
        size.alias("allSize"),
        ops_size(size, group).alias("allOpsSize"),
        analysis_size(size, group).alias("anaOpsSize"),
    ).withColumn("in_scope", F.col("max_age") <= max(windows))
    base_metrics = SIZE_METRICS[:3]
    sums = [
        F.expr(f"sum(CASE WHEN in_scope THEN {_size_days(metric, window)} END) AS {metric}{window}")
        for window in windows
        for metric in base_metrics
    ]
    grouped = (
        aged.groupBy("dataset_name")
        .agg(F.min("created").alias("created"), F.count_if("in_scope").alias("in_scope"), *sums)
        .where(F.col("in_scope") > 0)
    )
    sizes = {}
    for window in windows:
        for metric in base_metrics:
            mean = f"CAST({metric}{window} AS double) / {window}"
            sizes[f"{metric}{window}"] = mean
            sizes[f"old{metric[0].upper()}{metric[1:]}{window}"] = (
                f"CASE WHEN age > {window} THEN {mean} ELSE 0D END"
            )
    ids = catalog.where(F.col("d_dataset_id").isNotNull()).select(
        "d_dataset", F.col("d_dataset_id").alias("dataset_id")
    )
    named = grouped.withColumn("age", F.datediff(end, "created")).join(
        ids, F.col("dataset_name") == F.col("d_dataset")
    )
    return named.select(
        "dataset_id",
        tier(F.col("dataset_name")).alias("tier"),
        *[F.expr(f"{sizes[name]} AS {name}") for name in windowed(SIZE_METRICS, windows)],
    )


def _size_days(metric: str, window: int) -> str:
    """SQL: size times the days of the window it was held; 0 outside it or from the future."""
    days = f"(least({window}, min_age) - greatest(0, max_age))"
    return f"CASE WHEN max_age > {window} OR min_age < 0 THEN 0 ELSE {days} * {metric} END"
