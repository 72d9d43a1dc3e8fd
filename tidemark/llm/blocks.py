"""Exact dedup by deterministic block naming."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged
from tidemark.operators.skew import join_spread

BLOCK = 4096


def normalised(text: Column) -> Column:
    """Null as empty; only A-Z in lower case. ``lower`` does that for ASCII texts, and faster."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def _numbered(keys: DataFrame, order: list[str], name: Column) -> DataFrame:
    """Rows with an integer name: the partition and the place in it, sorted by ``order``."""
    return keys.sortWithinPartitions(*order).withColumn("name", name)


def _block_names(blocks: DataFrame) -> DataFrame:
    """(row_id, sha, n, pos, name) from (row_id, sha, n, pos, route, block): equal names for equal blocks only.

    Blocks are counted per route, a hash. A route whose least and greatest block are equal belongs to
    one block, so its number names the block without any chance of error; the blocks of the other
    routes are named by their text.
    """
    per_route = blocks.groupBy("route").agg(F.min("block").alias("least"), F.max("block").alias("most"))
    names = staged(
        _numbered(per_route, ["least"], F.monotonically_increasing_id()).select(
            "route", "name", (F.col("least") != F.col("most")).alias("shared")
        ),
        "names",
    )
    kept = ["row_id", "sha", "n", "pos", "name"]
    named = blocks.join(names.filter(~F.col("shared")), "route").select(*kept)
    shared = names.filter("shared").select("route")
    if shared.isEmpty():
        return named
    rest = staged(blocks.join(shared, "route", "left_semi"), "shared-routes")
    texts = staged(
        _numbered(
            rest.select("block").distinct(), ["block"], -1 - F.monotonically_increasing_id()
        ),
        "shared-names",
    )
    return named.unionByName(rest.join(texts, "block").select(*kept))


def identities(
    docs: DataFrame, block: int = BLOCK, route: Callable[[Column], Column] = F.xxhash64
) -> tuple[DataFrame, DataFrame]:
    """(row_id, sha) of every document, and (row_id, sha, n, name) of each different such pair.

    Texts are cut into blocks of ``block`` characters. Different blocks are sorted into integer
    names; then adjacent names pair up, different pairs are sorted into names, and so on until each
    text has one. Two texts are equal if, and only if, they have as many blocks and the same name.
    An empty text is one empty block. A block, or pair, that a third of all texts hold is combined
    before it is shuffled; joins on names leave heavy ones to adaptive execution.
    """
    text = normalised(F.col("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), 0)
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut)
    blocks = (
        docs.select(F.col("doc_id").alias("row_id"), text.alias("text"))
        .select("row_id", F.sha2("text", 256).alias("sha"), cut.alias("blocks"))
        .select("row_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
        .withColumn("route", route(F.col("block")))
    )
    named = staged(_block_names(blocks), "level-0")
    rows = named.filter("pos = 0").select("row_id", "sha")
    done = [named.filter("n = 1").select("row_id", "sha", "n", "name").distinct()]
    open_ = named.filter("n > 1")
    longest = named.agg(F.max("n")).first()[0] or 1
    span = 1
    while span < longest:
        span *= 2
        name_at = [F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1)]
        # the last of an odd number has no partner; no name is the least long
        second = F.coalesce(name_at[1], F.lit(-(2**63)))
        pairs = (
            open_.groupBy("row_id", "sha", "n", F.floor(F.col("pos") / 2).alias("pos"))
            .agg(name_at[0].alias("first"), second.alias("second"))
        )
        pairs = staged(pairs, f"pairs-{span}")
        different = pairs.select("first", "second").distinct()
        names = staged(
            _numbered(different, ["first", "second"], F.monotonically_increasing_id()),
            f"names-{span}",
        )
        named = pairs.join(names, ["first", "second"]).select("row_id", "sha", "n", "pos", "name")
        done.append(named.filter(F.col("n") <= span).select("row_id", "sha", "n", "name"))
        open_ = named.filter(F.col("n") > span)
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return rows, done[0]


def exact_copies(docs: DataFrame, **options) -> DataFrame:
    """For every document: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest doc_id stays; a null doc_id is smaller than any. Of repeated rows
    of one doc_id and text one stays. An empty table gives an empty one.
    """
    rows, found = identities(docs, **options)
    rows, found = rows.groupBy("row_id", "sha").agg(F.count("*").alias("times")).alias("d"), found.alias("i")
    same = F.col("d.row_id").eqNullSafe(F.col("i.row_id")) & (F.col("d.sha") == F.col("i.sha"))
    rows = staged(rows.join(found, same).select("d.row_id", "d.sha", "times", "n", "name"), "identities")
    groups = rows.groupBy("n", "name").agg(
        F.max("row_id").alias("keep_id"), F.sum("times").alias("group_size")
    )
    # a document that came several times is given so often, a thousand rows at a time
    some, last = F.lit(1000).cast("long"), F.col("times") - 1
    every = join_spread(rows, groups, ["n", "name"])
    every = every.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / some))))
    nth = F.sequence(F.col("lot") * some, F.least(last, F.col("lot") * some + some - 1))
    every = every.withColumn("nth", F.explode(nth))
    kept = F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)
    return every.select(
        F.col("row_id").alias("doc_id"),
        "keep_id",
        "group_size",
        kept.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    stay = exact_copies(docs.select("doc_id", "text"), **options).filter("kept")
    stay = stay.select(F.col("doc_id").alias("row_id"), F.col("text_sha256").alias("sha")).alias("s")
    rows = docs.select(F.struct("*").alias("row"), F.sha2(normalised(F.col("text")), 256).alias("sha"))
    same = F.col("row.doc_id").eqNullSafe(F.col("s.row_id")) & (F.col("r.sha") == F.col("s.sha"))
    kept = rows.alias("r").join(stay, same).groupBy("r.row.doc_id", "r.sha").agg(F.first("r.row").alias("one"))
    return kept.select("one.*")
