"""Mixing sources to target weights by hash-random order, prefix sums and exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import staged, word_count

WEIGHTS = (5, 2, 1)
CEILING = 3
#: Documents in one key range of the range sort, on average.
RANGE_ROWS = 2048


def _ranked(groups: DataFrame) -> DataFrame:
    """One row per source with its place in code-point order, null last.

    The sources are range-sorted; what one task sees is their number in each range.
    """
    ordered = staged(
        groups.groupBy("source")
        .agg(F.sum("words").alias("words"))
        .orderBy(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id()),
        "sources",
    )
    part = F.shiftright("at", 33)
    ahead = (
        ordered.groupBy(part.alias("part"))
        .agg(F.count("*").alias("n"))
        .withColumn(
            "ahead",
            F.coalesce(
                F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("n")
    )
    place = F.col("ahead") + F.col("at") - F.shiftleft("part", 33)
    return ordered.withColumn("part", part).join(ahead, "part").select("source", "words", place.alias("place"))


def source_targets(
    groups: DataFrame, weights: Sequence[float] = WEIGHTS, ceiling: float = CEILING
) -> DataFrame:
    """Each source's size and target, from rows of (source, words).

    Sources in code-point order, null last, get the weights in turn and share the total of all
    words. No target exceeds ``ceiling`` times its source's size: what is above is shared among the
    other sources by weight until none is above. Sources without words have target 0.
    """
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")
    )
    most = F.col("words") * ceiling
    sources = staged(
        _ranked(groups).select("source", "words", weight.alias("weight"), most.alias("most")),
        "weights",
    )
    total, open_weight = sources.agg(F.sum("words"), F.sum("weight")).first()
    level, closed = 0.0, -1
    while total:
        # A source's share is level * weight; raising the level closes further sources, never opens one.
        above = F.col("most") < F.lit(level) * F.col("weight")
        n, taken, rest = sources.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)),
            F.sum(F.when(~above, F.col("weight"))),
        ).first()
        if n == closed:
            break
        closed, level = n, (total - taken) / rest
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return sources.select("source", F.col("words").alias("source_size"), target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    ceiling: float = CEILING,
    seed: str = "mix",
    into: str = "mix",
    size: Column | None = None,
) -> DataFrame:
    """How many words of each document a mixture of the sources takes.

    Every document gets a hash-random key. Within each source the documents are sorted by ranges of
    that key; sums over ranges and running sums inside a range give the words ahead of a document.
    A source's budget is its target, rounded down: whole passes over the source first, then the
    documents in key order until the budget is spent, the last one in part. So the words taken from
    a source are its budget exactly.

    A document's size is its number of words, or else the column ``size``.

    Result: the columns of ``docs`` and a struct ``into`` (replacing a column of that name) of size,
    source_size, target, passes and taken. Null or empty texts have size 0 and give nothing; a null source
    is a source; repeated rows count each; an empty table gives an empty one.
    """
    ranges = max(1, docs.count() // RANGE_ROWS)
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"/{seed}")))
    first = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    keyed = docs.drop(into).select(
        F.struct("*").alias("row"),
        F.col("source").alias("source"),
        (word_count(F.col("text")) if size is None else size).alias("size"),
        key.alias("key"),
        F.floor(first * ranges / F.lit(2.0**32)).cast("long").alias("range"),
    )
    groups = staged(
        keyed.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges"
    )
    targets = source_targets(groups, weights, ceiling)
    ahead = F.sum("words").over(
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranged = groups.withColumn("ahead", F.coalesce(ahead, F.lit(0))).alias("g")
    ranged = ranged.join(
        targets.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))
    ).select("g.source", "range", "ahead", "source_size", "target")
    inside = F.sum("size").over(
        Window.partitionBy("source", "range")
        .orderBy("key", F.col("row.doc_id"), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = keyed.withColumn("inside", F.coalesce(inside, F.lit(0))).alias("k")
    same = F.col("k.source").eqNullSafe(F.col("r.source")) & (F.col("k.range") == F.col("r.range"))
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("passes") * F.col("source_size")
    left = rest - F.col("ahead") - F.col("inside")
    taken = F.col("size") * F.col("passes") + F.greatest(F.lit(0), F.least("size", left))
    return (
        placed.join(ranged.alias("r"), same)
        .withColumn("passes", passes.cast("long"))
        .withColumn("taken", taken.cast("long"))
        .select("row.*", F.struct("size", "source_size", "target", "passes", "taken").alias(into))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as documents: each appears as often as it is taken, with its columns as they are.

    A source's last document is kept whole if at least half of it is within the budget, else left
    out, so a source may miss its target by half a document. Documents without words stay once: they
    have no weight in any mixture.
    """
    into = "mix"
    while into in docs.columns:
        into += "_"
    size, taken = F.col(f"{into}.size"), F.col(f"{into}.taken")
    times = F.when(size > 0, F.floor(taken / size + 0.5)).otherwise(1).cast("int")
    mixture = mix(docs, into=into, **options).withColumn(into, times).filter(F.col(into) > 0)
    repeated = mixture.withColumn(into, F.explode(F.sequence(F.lit(1), into)))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(sized, size=F.col("size"), **options).select(
        "doc_id",
        *[F.col(f"mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")],
    )
