"""Sketches of stored days, merged over any range of days without reading the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the distinct-count sketches (2^12 registers, about 1.6 % error) and of the quantile sketches
#: (about 1.3 % error of rank).
DISTINCT_BITS, QUANTILE_SIZE = 12, 200


def sketched(
    df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()
) -> DataFrame:
    """A row for each group of ``by``: n, and for each column a sketch as binary.

    ``distinct_<column>`` tells how many different values there are, ``quantiles_<column>`` how they are
    distributed (as doubles; nulls count in neither). Sketches have a fixed size, so a group of any
    number of rows leaves its map tasks as a few kilobytes.
    """
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.hll_sketch_agg(c, DISTINCT_BITS).alias(f"distinct_{c}") for c in distinct],
        *[
            F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILE_SIZE)).alias(f"quantiles_{c}")
            for c in quantiles
        ],
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """The sketches of ``sketched`` put together for each group of ``by``, one row in all by default."""
    columns = [c for c in sketches.columns if c.startswith(("distinct_", "quantiles_"))]
    merge = {"distinct_": F.hll_union_agg, "quantiles_": F.kll_merge_agg_double}
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[merge[c[: c.index("_") + 1]](c).alias(c) for c in columns],
    )


def estimates(sketches: DataFrame, ranks: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """What sketches tell: distinct counts as numbers, and the values at ``ranks`` as arrays of doubles."""
    columns = []
    for name in sketches.columns:
        if name.startswith("distinct_"):
            columns.append(F.hll_sketch_estimate(name).alias(name))
        elif name.startswith("quantiles_"):
            at = F.array(*[F.lit(float(rank)) for rank in ranks])
            columns.append(F.kll_sketch_get_quantile_double(name, at).alias(name))
        else:
            columns.append(F.col(name))
    return sketches.select(*columns)
