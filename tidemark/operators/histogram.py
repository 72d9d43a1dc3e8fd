"""Popularity histogram: bytes per read bin for every size metric, read metric, category, window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.metrics import READ_BINS, READ_METRICS, SIZE_METRICS, WINDOWS
from tidemark.functions.names import tier_categories

_BIN_COLUMNS = [str(i) for i in range(READ_BINS)]


def histogram_names(windows: Sequence[int] = WINDOWS) -> list[str]:
    return [
        f"sums_{size}_{read}_{category}_{window}"
        for window in windows
        for size in SIZE_METRICS
        for read in READ_METRICS
        for category in tier_categories()
    ]


def popularity_histogram(pop: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Rows (name, "0".."15"): bytes by read bin. Empty bins hold 0.0.

    Datasets are reduced first to one row per (window, read metric, bin, tier class) carrying all
    size metrics; a tier class is the set of categories a tier belongs to. What is left has a fixed
    upper size whatever the input, and only that is spread over categories and metrics.
    """
    categories = tier_categories()
    member = {name: F.coalesce(test, F.lit(False)) for name, test in categories.items()}
    # generated as SQL text: hundreds of column objects would take longer to build than to run
    pairs = ", ".join(
        _named_struct(
            {"window": str(window), "read": f"'{read}'", "bin": f"{read}{window}"}
            | {size: f"{size}{window}" for size in SIZE_METRICS}
        )
        for window in windows
        for read in READ_METRICS
    )
    classes = (
        pop.select(
            *[test.alias(name) for name, test in member.items()],
            F.expr(f"inline(array({pairs}))"),
        )
        .where(F.col("bin").isin(*range(READ_BINS)))
        .groupBy("window", "read", "bin", *member)
        .agg(*[F.sum(size).alias(size) for size in SIZE_METRICS])
    )
    cells = classes.select(
        "window",
        "read",
        "bin",
        F.explode(
            F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in member]))
        ).alias("category"),
        *SIZE_METRICS,
    ).unpivot(["window", "read", "bin", "category"], list(SIZE_METRICS), "size", "bytes")
    name = F.concat_ws("_", F.lit("sums"), "size", "read", "category", "window")
    names = F.split(F.lit(" ".join(histogram_names(windows))), " ")
    every_name = pop.sparkSession.range(1).select(
        F.explode(names).alias("name"),
        F.lit(None).alias("bin"),
        F.lit(None).alias("bytes"),
    )
    filled = cells.select(name.alias("name"), "bin", "bytes").unionByName(every_name)
    return filled.groupBy("name").agg(*[_bin_total(i).alias(str(i)) for i in range(READ_BINS)])


def _named_struct(fields: dict[str, str]) -> str:
    pairs = [f"'{name}', {value}" for name, value in fields.items()]
    return f"named_struct({', '.join(pairs)})"


def _bin_total(i: int) -> Column:
    return F.expr(f"coalesce(CAST(sum(CASE WHEN bin = {i} THEN bytes END) AS double), 0D)")


def histogram_long(histogram: DataFrame) -> DataFrame:
    """Rows (name, bin, bytes), 16 per name."""
    long = histogram.unpivot("name", _BIN_COLUMNS, "bin", "bytes")
    return long.withColumn("bin", F.col("bin").cast("int"))


def histogram_arrays(histogram: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One row, one 16-element array column per histogram name: the shape stored as JSON."""
    arrays = histogram.select("name", F.array(*_BIN_COLUMNS).alias("bins"))
    return arrays.groupBy().pivot("name", histogram_names(windows)).agg(F.first("bins"))


def histogram_from_arrays(arrays: DataFrame) -> DataFrame:
    """Back from one row of array columns to rows (name, "0".."15")."""
    rows = arrays.unpivot([], arrays.columns, "name", "bins")
    return rows.select(
        "name", *[F.get("bins", F.lit(i)).alias(str(i)) for i in range(READ_BINS)]
    )
