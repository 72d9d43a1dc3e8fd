"""Pairs of overlapping day intervals, joined on bins of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.days import as_date

#: Days of a bin. An interval is copied once for each bin it touches.
BIN_DAYS = 30
#: Nodes of the tree over the days have 2 ** NODE_BITS children; its levels hold the days from -ZERO to ZERO.
NODE_BITS, LEVELS, ZERO = 3, 8, 1 << 23


def overlapping(
    left: DataFrame,
    right: DataFrame,
    left_days: tuple[str, str],
    right_days: tuple[str, str],
    keys: Sequence[str] = (),
    bin_days: int = BIN_DAYS,
) -> DataFrame:
    """Every pair of a row of ``left`` and one of ``right`` whose intervals share a day, with all columns.

    Intervals are (first, last) days, dates or day strings, both included; one without first or last day, or
    that ends before it begins, has no day. ``keys`` are columns of both that must be equal, too, and come once; all
    other columns must differ in name.

    Both sides are dealt to bins of ``bin_days`` days, and joined on bin and keys, so that the work is spread over
    the calendar and nothing is compared across it. A pair may share several bins; it is given in the
    first of them only, the later of the two bins that the intervals begin in. Choose bins about as long as
    usual intervals: shorter ones copy more, longer ones compare more.
    """
    if bin_days < 1:
        raise ValueError("a bin has a day at least")
    one, two = _binned(left, left_days, bin_days, "l"), _binned(right, right_days, bin_days, "r")
    joined = one.join(two, ["_bin", *keys])
    share = (F.col("_first_l") <= F.col("_last_r")) & (F.col("_first_r") <= F.col("_last_l"))
    first_shared = F.greatest(_bin(F.col("_first_l"), bin_days), _bin(F.col("_first_r"), bin_days))
    found = joined.where(share & (F.col("_bin") == first_shared))
    return found.drop("_bin", "_first_l", "_last_l", "_first_r", "_last_r")


def _bin(day: Column, bin_days: int) -> Column:
    return F.floor(day / F.lit(bin_days)).cast("int")


def _binned(df: DataFrame, days: tuple[str, str], bin_days: int, side: str) -> DataFrame:
    first, last = (F.unix_date(as_date(df, name)) for name in days)
    known = df.withColumns({f"_first_{side}": first, f"_last_{side}": last})
    first, last = F.col(f"_first_{side}"), F.col(f"_last_{side}")
    bins = F.sequence(_bin(first, bin_days), _bin(last, bin_days))
    return known.where(first <= last).withColumn("_bin", F.explode(bins))


def alive_during(replicas: DataFrame, periods: DataFrame, bin_days: int = BIN_DAYS) -> DataFrame:
    """Of each period (period_id, first_day, last_day): the replicas that lived on one of its days.

    Columns: period_id, replicas, datasets, rep_size (bytes), byte_days (bytes times days shared). Periods without
    replicas are left out; rows of one period_id are one period, of which each row counts its replicas.

    No pair of a replica and a period is made. What lived in ``a..b`` is what began by ``b`` less what ended before
    ``a``, so replicas and bytes are differences of running sums over the calendar. A dataset lived in it if it
    began by ``b``, did not end before ``a`` and has no gap around ``a..b``; gaps are counted in nodes of a tree over
    the days. Only the datasets of a period_id that has several separate stretches of days are looked for by pairs,
    in bins of ``bin_days``. Sizes stored as double are summed as decimals of six places.
    """
    if bin_days < 1:
        raise ValueError("a bin has a day at least")
    lived = _valid(replicas, ("min_time", "max_time"), ("dataset_name", "rep_size"))
    stays = _valid(periods, ("first_day", "last_day"), ("period_id",))
    rows = stays.groupBy("period_id", "first", "last").agg(F.count("*").alias("times"))
    stretches = _stretches(rows, "period_id")
    lives = _stretches(lived.where(F.col("dataset_name").isNotNull()), "dataset_name")
    spans = rows.select("first", "last").unionByName(stretches.select("first", "last")).distinct()

    size_type = replicas.schema["rep_size"].dataType
    exact = isinstance(size_type, T.DecimalType)
    scale = size_type.scale if exact else 0 if isinstance(size_type, T.IntegralType) else 6
    size = F.col("rep_size").cast(f"decimal(38,{scale})")
    alive = _alive(lived.withColumn("size", size), lives, spans)
    if exact:
        kinds = [f"decimal({min(38, size_type.precision + more)},{scale})" for more in (20, 31)]
    else:
        kinds = ["bigint" if scale == 0 else "double"] * 2

    same = [F.col("p.first") == F.col("s.first"), F.col("p.last") == F.col("s.last")]
    summed = (
        rows.alias("p")
        .join(alive.alias("s"), same)
        .groupBy("period_id")
        .agg(
            F.sum(F.col("times") * F.col("replicas")).alias("replicas"),
            *[F.sum(F.col("times") * F.col(name)).cast(kind).alias(name) for name, kind in zip(("rep_size", "byte_days"), kinds, strict=True)],
        )
        .where(F.col("replicas") > 0)
    )
    one = stretches.groupBy("period_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n"))
    datasets = one.where("n = 1").alias("p").join(alive.alias("s"), same).select("period_id", "datasets")
    several = one.where("n > 1").select(F.col("period_id").alias("id"))
    if not several.isEmpty():
        apart = stretches.join(several, F.col("period_id").eqNullSafe(F.col("id")), "left_semi")
        days = [F.date_from_unix_date(F.col(name)).alias(f"p_{name}") for name in ("first", "last")]
        lives = lives.select("dataset_name", *[F.date_from_unix_date(F.col(name)).alias(name) for name in ("first", "last")])
        pairs = overlapping(lives, apart.select("period_id", *days), ("first", "last"), ("p_first", "p_last"), bin_days=bin_days)
        found = pairs.groupBy("period_id", "dataset_name").agg(F.lit(1).alias("one"))
        datasets = datasets.unionByName(found.groupBy("period_id").agg(F.count("*").alias("datasets")))
    datasets = datasets.withColumnRenamed("period_id", "id")
    return summed.join(datasets, F.col("period_id").eqNullSafe(F.col("id")), "left").select(
        "period_id", "replicas", F.coalesce("datasets", F.lit(0)).cast("bigint").alias("datasets"), "rep_size", "byte_days"
    )


def _valid(df: DataFrame, days: tuple[str, str], kept: Sequence[str]) -> DataFrame:
    """``kept``, and as numbers the days ``first`` and ``last``, of the rows that have a day."""
    first, last = (F.unix_date(as_date(df, name)) for name in days)
    return df.select(*kept, first.alias("first"), last.alias("last")).where(F.col("first") <= F.col("last"))


def _stretches(df: DataFrame, key: str) -> DataFrame:
    """(key, first, last): the days of each key as stretches that neither overlap nor touch.

    A window group has a row for each day of the calendar at most.
    """
    begun = df.groupBy(key, "first").agg(F.max("last").alias("last"))
    in_order = Window.partitionBy(key).orderBy("first")
    before = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = begun.withColumn("apart", (before.isNull() | (F.col("first") > before + 1)).cast("int"))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("stretch", F.sum("apart").over(so_far))
    return numbered.groupBy(key, "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("stretch")


def _alive(lived: DataFrame, lives: DataFrame, spans: DataFrame) -> DataFrame:
    """(first, last, replicas, datasets, rep_size, byte_days) of each of ``spans``.

    ``lived`` are replicas (first, last, size), ``lives`` the stretches of each dataset.
    """
    sized = F.col("size").isNotNull().cast("bigint")
    changes = lived.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.col(day).alias("day"),
                        F.lit(sign).alias("sign"),
                        F.lit(1).cast("bigint").alias("n"),
                        F.col("size"),
                        sized.alias("sized"),
                        (F.col("size") * F.col(day).cast("decimal(10,0)")).alias("weight"),
                    )
                    for day, sign in (("first", 1), ("last", -1))
                ]
            )
        )
    )
    ends = lives.groupBy("dataset_name").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    known = ends.select(
        F.inline(
            F.array(
                F.struct(F.col("first").alias("day"), F.lit(1).alias("sign"), F.lit(1).cast("bigint").alias("datasets")),
                F.struct(F.col("last").alias("day"), F.lit(-1).alias("sign"), F.lit(1).cast("bigint").alias("datasets")),
            )
        )
    )
    names = ("n", "size", "sized", "weight", "datasets")
    per_day = changes.unionByName(known, allowMissingColumns=True).groupBy("day", "sign").agg(*[F.sum(name).alias(name) for name in names])
    # up to the last day of a span all count that began, up to the day before its first one all that ended
    asked = spans.select(F.explode(F.array("last", F.col("first") - 1)).alias("day")).distinct()
    asked = asked.select("day", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    by_day = per_day.unionByName(asked, allowMissingColumns=True)
    by_day = by_day.groupBy("day", "sign").agg(*[F.sum(name).alias(name) for name in names])
    # a group has two rows for each day of the calendar at most
    so_far = Window.partitionBy("sign").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = by_day.select("day", "sign", *[F.coalesce(F.sum(name).over(so_far), F.lit(0)).alias(name) for name in names])
    sums = sums.groupBy("day").agg(
        *[F.max(F.when(F.col("sign") == sign, F.col(name))).alias(f"{name}_{side}") for sign, side in ((1, "in"), (-1, "out")) for name in names]
    )
    at_last = sums.select(*[F.col(name).alias(f"l_{name}") for name in sums.columns])
    at_first = sums.select(*[F.col(name).alias(f"f_{name}") for name in sums.columns])
    joined = spans.join(at_last, F.col("last") == F.col("l_day")).join(at_first, F.col("first") - 1 == F.col("f_day"))
    around = _gaps_around(lives, spans)
    joined = joined.join(around, ["first", "last"], "left")

    def held(side: str) -> Column:
        """Bytes times days, up to and with the day of a side, of all replicas until then."""
        day = F.col(f"{side}_day").cast("decimal(10,0)")
        inside = F.col(f"{side}_size_in") * (day + 1) - F.col(f"{side}_weight_in")
        return inside - (F.col(f"{side}_size_out") * day - F.col(f"{side}_weight_out"))

    def within(name: str) -> Column:
        return F.col(f"l_{name}_in") - F.col(f"f_{name}_out")

    has_size = within("sized") > 0
    return joined.select(
        "first",
        "last",
        within("n").alias("replicas"),
        (within("datasets") - F.coalesce("around", F.lit(0))).alias("datasets"),
        F.when(has_size, within("size")).alias("rep_size"),
        F.when(has_size, held("l") - held("f")).alias("byte_days"),
    )


def _gaps_around(lives: DataFrame, spans: DataFrame) -> DataFrame:
    """(first, last, around): how many gaps between stretches of a dataset begin before and end after a span.

    A gap stands in one node of each level, that of the day before it; the days before a span are few whole
    nodes. A window group has a node's gaps by the day they end: two rows for each day at most.
    """
    before = F.lag("last").over(Window.partitionBy("dataset_name").orderBy("first"))
    gaps = lives.select(before.alias("before"), F.col("first").alias("after")).where(F.col("before").isNotNull())
    gaps = gaps.groupBy("before", "after").agg(F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    points = gaps.select("*", level).select("level", _node("before"), F.col("after").alias("day"), "n")
    asked = spans.select("*", level).select("*", _node("first"))
    digit = F.col("node") % (1 << NODE_BITS)
    whole = F.sequence(F.col("node") - digit, F.col("node") - 1)
    asked = asked.where(digit > 0).select("first", "last", "level", F.explode(whole).alias("node"))
    days = asked.select("level", "node", F.col("last").alias("day"), F.lit(0).cast("bigint").alias("n"))
    by_day = points.unionByName(days).groupBy("level", "node", "day").agg(F.sum("n").alias("n"))
    from_day = Window.partitionBy("level", "node").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = by_day.select("level", "node", F.col("day").alias("last"), (F.sum("n").over(from_day) - F.col("n")).alias("later"))
    found = asked.join(later.where("later > 0"), ["level", "node", "last"])
    return found.groupBy("first", "last").agg(F.sum("later").alias("around"))


def _node(day: str) -> Column:
    return F.expr(f"shiftright({day} + {ZERO}, {NODE_BITS} * level)").alias("node")
