"""Sizes and reads per dataset side by side, manual overrides, and the unused-data reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.metrics import READ_METRICS, WINDOWS, windowed
from tidemark.functions.names import unused_campaign

def popularity(
    sizes: DataFrame, reads: DataFrame, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """Window sizes and read bins per dataset. Datasets without reads get bin 0; datasets without
    replicas keep NULL sizes and tier.
    """
    joined = sizes.join(reads, F.col("dataset_id") == F.col("d_dataset_id"), "full")
    return (
        joined.withColumn("dataset_id", F.coalesce("dataset_id", "d_dataset_id"))
        .drop("d_dataset_id")
        .fillna(0, windowed(READ_METRICS, windows))
    )


def resolve_overrides(overrides: DataFrame, catalog: DataFrame) -> DataFrame:
    """Overrides (dataset_name, value) by dataset id; unknown names drop out."""
    return overrides.join(
        catalog.select("d_dataset", "d_dataset_id"), F.col("dataset_name") == F.col("d_dataset")
    ).select("d_dataset_id", "value")


def apply_overrides(
    pop: DataFrame, overrides: DataFrame, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """Every read bin of an overridden dataset becomes the override's value.

    An override of a dataset in neither input adds a row whose ``dataset_id`` is NULL; a second
    override of one dataset doubles its row. A value outside 0..15 lands in no histogram bin.
    """
    joined = pop.join(overrides, F.col("dataset_id") == F.col("d_dataset_id"), "full")
    return joined.withColumns(
        {name: F.coalesce("value", name) for name in windowed(READ_METRICS, windows)}
    )


def override_daily(daily: DataFrame, overrides: DataFrame) -> DataFrame:
    """Operations bytes per date of the overridden datasets."""
    return (
        daily.join(overrides, F.col("dataset_id") == F.col("d_dataset_id"))
        .groupBy("date")
        .agg(F.sum("allOpsSize").alias("size"))
    )


def top_unused(
    pop: DataFrame,
    catalog: DataFrame,
    window: int = 180,
    k: int = 5000,
    windows: Sequence[int] = WINDOWS,
) -> DataFrame:
    """The ``k`` largest datasets not read in ``window`` days, by name, largest first.

    Ties in size go to the smaller id. The ``k`` are taken before names are looked up, so datasets
    missing from the catalogue leave fewer rows.
    """
    by_size = F.col(f"allSize{window}").desc()
    columns = [f"allSize{w}" for w in windows]
    largest = (
        pop.where(F.col(f"fract_read{window}") < 1)
        .orderBy(by_size, "dataset_id")
        .select("dataset_id", *columns)
        .limit(k)
    )
    return (
        catalog.select("d_dataset", "d_dataset_id")
        .join(largest, F.col("dataset_id") == F.col("d_dataset_id"))
        .orderBy(by_size, "dataset_id")
        .select("d_dataset", *columns)
    )


def unused_by_campaign(unused: DataFrame, size: str = "allSize365") -> DataFrame:
    """Unused terabytes per campaign."""
    return unused.groupBy(unused_campaign(F.col("d_dataset")).alias("campaign")).agg(
        (F.sum(F.col(size)).cast("double") / F.lit(1e12)).alias("tb")
    )
