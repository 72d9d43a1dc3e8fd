"""Writers. Each replaces what was at its path; ``write_by_month`` only the months it writes."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.session import shuffles_dropped
from tidemark.sinks.bucketed import input_bytes

# Bits of a long that the first and the second sort key get in ``packed``.
_FIRST_BITS, _SECOND_BITS = 24, 40
#: Rows that take as many bytes, stored, are sorted in so many slices.
SLICED_BYTES, SLICES = 16 << 20, 3


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file, for reports bounded by the calendar (a row per day), never for data.

    ``repartition`` rather than ``coalesce``: the plan above keeps its parallelism and only the
    finished report rows meet in one task.
    """
    df.repartition(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, for rows with array columns that CSV cannot hold."""
    df.write.mode("overwrite").json(path)


def write_sorted_parquet(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet range-partitioned and sorted by ``keys``, so that filters on the leading key skip
    files and row groups.

    Ranging over all keys lets the rows of one heavy leading key spread over several files. Many rows
    share a leading key such as a day, so rows are compared by ``packed`` keys first where they allow it.

    Rows are made once and stored beside ``path`` as they come, where neighbours are alike and take little room;
    the shuffles that made them go then. They are sorted one slice of the leading key after another, so that the
    shuffle of one slice is on disk at a time. What was at ``path`` is replaced when all slices are written; where
    that fails between deleting and renaming, all rows are at ``<path>_sorted-<id>``.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    unsorted, done = (f"{path}_{kind}-{uuid4().hex}" for kind in ("unsorted", "sorted"))
    try:
        with shuffles_dropped(spark):
            write_parquet(df, unsorted)
            rows = spark.read.schema(df.schema).parquet(unsorted)
            for wanted in _sliced(rows, keys[0], SLICES if input_bytes(spark, unsorted) >= SLICED_BYTES else 1):
                some = rows.where(wanted)
                ordered = some.repartitionByRange(*keys).sortWithinPartitions(*packed(some, *keys), *keys)
                ordered.write.mode("append").option("compression", "snappy").parquet(done)
    except BaseException:
        _delete(spark, done)
        raise
    finally:
        _delete(spark, unsorted)
    _delete(spark, path)
    _rename(spark, done, path)
    spark.catalog.refreshByPath(path)


def _sliced(rows: DataFrame, key: str, slices: int) -> list[Column]:
    """Conditions that cut ``rows`` by ``key``, a day or whole number, in about equal slices; one if it is neither.

    Each row is in one of them, wherever they are cut, which a fiftieth of the rows tells. A heavy value is in one
    slice with all its rows, so there may be fewer.
    """
    kind = rows.schema[key].dataType
    value = F.unix_date(key) if isinstance(kind, T.DateType) else F.col(key)
    if slices == 1 or not isinstance(kind, (T.DateType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return [F.lit(True)]
    at = F.percentile_approx(value, [i / slices for i in range(1, slices)], 1000)
    bounds = sorted(set(rows.select(key).sample(0.02, seed=1).select(at).first()[0] or []))
    if not bounds:
        return [F.lit(True)]
    between = [(value > a) & (value <= b) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [F.isnull(key) | (value <= bounds[0]), *between, value > bounds[-1]]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    if not old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new):
        raise OSError(f"could not rename {source} to {target}")


def packed(df: DataFrame, *keys: str) -> list[Column]:
    """A long that ascends with the first two of ``keys``, if those are a day or small number and a number.

    It is no sort key alone: numbers beyond its bits share a value. Spark compares the first sort key in
    place, without fetching rows, and looks at the next keys only where it is equal.
    """
    small, whole = (T.ByteType, T.ShortType, T.IntegerType), (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = [df.schema[key].dataType for key in keys[:2]]
    if len(kinds) < 2 or not isinstance(kinds[0], (T.DateType, *small)) or not isinstance(kinds[1], whole):
        return []
    first, second = F.col(keys[0]), F.col(keys[1]).cast("bigint")
    first = (F.unix_date(first) if isinstance(kinds[0], T.DateType) else first).cast("bigint")
    most, half = 1 << (_FIRST_BITS - 1), 1 << (_SECOND_BITS - 1)
    low = F.greatest(F.least(F.coalesce(second, F.lit(-half)), F.lit(half - 1)), F.lit(-half)) + F.lit(half)
    inside = first * F.lit(2 * half) + low
    return [F.when(first < -most, F.lit(-(1 << 63))).when(first >= most, F.lit((1 << 63) - 1)).otherwise(inside)]


def stage_label(dates: str, separator: str = "/") -> str:
    """Directory for a date pattern: its parts without wildcards (``2020/01/*`` -> ``2020/01``).

    A pattern of wildcards only would name the directory above all others, so it is refused.
    """
    label = "/".join(part for part in dates.split(separator) if part and "*" not in part)
    if not label:
        raise ValueError(f"date pattern {dates!r} names no directory of its own")
    return label


def write_by_month(df: DataFrame, path: str, day: str) -> None:
    """Parquet under ``year=/month=`` of the date column ``day``; only the months in ``df`` are
    replaced. Readers that filter on year and month then touch no other directory.

    Rows are brought together by month first, in tasks of bounded size: a task that made the rows does not sort
    them as well, and does not write a file for every month.
    """
    dated = df.withColumns({"year": F.year(day), "month": F.month(day)})
    (
        dated.hint("rebalance", "year", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("year", "month")
        .parquet(path)
    )
