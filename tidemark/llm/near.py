"""Near-duplicate documents by BagMinHash signatures, bands and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import coded_words, mixed, slices, staged, window_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the threshold shares none of the bands with probability (1 - 0.8 ** 8) ** 64 = 8e-6.
BANDS, BAND_ROWS = 64, 8
#: Times as many documents as before lead in a bucket in each turn.
LEADERS_GROW = 64
#: Agreement of two signatures, of 512 places, below which a pair is not compared word by word: five
#: standard deviations under the threshold, so a link is missed with probability 3e-7.
LEAST_AGREEMENT = 0.71
#: Members of a bucket that one task compares with its leaders.
CHUNK = 1000
_LOW48 = np.uint64((1 << 48) - 1)
_STEP = 0x9E3779B97F4A7C15


def weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 48-bit hash and number of occurrences of each different shingle, documents in turn.

    A text of fewer than five words, but one at least, is one shingle.
    """
    starts, codes, words = coded_words(texts)
    shingles, doc = window_hashes(starts, word_hashes(words)[codes], SHINGLE, short=True)
    both = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (shingles & _LOW48))
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, int)
    weight = np.diff(np.append(first, len(both)))
    both = both[first]
    return (both >> np.uint64(48)).astype(np.int64), both & _LOW48, weight


def signatures(
    docs: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, size: int
) -> np.ndarray:
    """BagMinHash signatures: two documents agree at a place with probability their weighted Jaccard.

    The weight axis of an element is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8), ... Each
    carries a Poisson process of its own, seeded by element and interval, whose points come in
    ascending order; a point has a place in the signature and, in the topmost interval, counts only
    if it lies below the element's weight. A place keeps its first point. Points are drawn up to
    a time at which most documents have all places filled; the others go on to twice that.

    ``docs`` are all document numbers wanted, each with an element at least.
    """
    top = np.ceil(np.log2(weight)).astype(np.int64)
    owner = np.repeat(np.arange(len(weight)), top + 1)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    length = np.where(level > 0, low, 1.0)
    part = np.minimum(1.0, (weight[owner] - low) / length)
    seed = mixed(element[owner] + (level.astype(np.uint64) << np.uint64(50)))
    mean = 1 / (size * length)
    whose = doc[owner]
    total = np.bincount(doc, weight, int(docs.max()) + 1 if len(docs) else 0)
    first = np.full((len(total), size), np.inf)
    until = (np.log(size) + 4) / np.maximum(total, 1)
    wanted = np.zeros(len(total), bool)
    wanted[docs] = True
    while wanted.any():
        first[wanted] = np.inf
        live = np.flatnonzero(wanted[whose])
        key, of, step, share = seed[live], whose[live], mean[live], part[live]
        end, time, turn = until[of], np.zeros(len(live)), 0
        while len(key):
            # few processes draw many points at once; the sums are the same as one by one
            turns = turn + 1 + np.arange(max(1, min(128, 65536 // len(key))), dtype=np.uint64)
            turn += len(turns)
            drawn = mixed(key[:, None] + turns * np.uint64(_STEP))
            waits = -np.log(((drawn >> np.uint64(32)) + 0.5) / 2.0**32) * step[:, None]
            waits[:, 0] += time
            times = np.cumsum(waits, axis=1)
            rows, columns = np.nonzero(times <= end[:, None])
            drawn, at = drawn[rows, columns], of[rows] * size
            at += (((drawn & np.uint64(0xFFFF)) * np.uint64(size)) >> np.uint64(16)).astype(np.int64)
            inside = ((drawn >> np.uint64(16)) & np.uint64(0xFFFF)) < share[rows] * 65536
            np.minimum.at(first.reshape(-1), at[inside], times[rows, columns][inside])
            time = times[:, -1]
            on = time <= end
            key, of, step, share, end, time = (a[on] for a in (key, of, step, share, end, time))
        wanted &= np.isinf(first).any(axis=1)
        until[wanted] *= 2
    return first[docs]


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (shingles), key and key2 (of the multiset), bands and sketch of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            n = batch.num_rows
            doc, element, weight = weighted_shingles(batch.column(2))
            total = np.bincount(doc, weight, n).astype(np.int64)
            keys = []
            for salt in (1, 2):
                terms = mixed(element + np.uint64(salt << 50)) * weight.astype(np.uint64)
                ends = np.searchsorted(doc, np.arange(n + 1))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
                keys.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
            some = np.flatnonzero(total)
            found = signatures(some, doc, element, weight, BANDS * BAND_ROWS).view(np.uint64)
            found = found.reshape(len(some), BANDS, BAND_ROWS)
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS))
            for k in range(BAND_ROWS):
                band = mixed(band * np.uint64(_STEP) + found[:, :, k])
            sizes = np.zeros(n, np.int64)
            sizes[some] = BANDS
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                pa.array(band.reshape(-1).view(np.int64)),
            )
            width = BANDS * BAND_ROWS
            sketch = np.zeros((n, width), np.uint8)
            sketch[some] = (mixed(found) & np.uint64(255)).astype(np.uint8).reshape(-1, width)
            sketches = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(width), n, [None, pa.py_buffer(sketch)]
            ).cast(pa.binary())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(total), *map(pa.array, keys), bands, sketches],
                names=["doc_id", "text_key", "n", "key", "key2", "bands", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _text_key(), "text").mapInArrow(
        sign,
        f"doc_id {kind}, text_key bigint, n bigint, key bigint, key2 bigint, bands array<bigint>, "
        "sketch binary",
    )


def _text_key():
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))).alias("text_key")


def _overlap(pairs: DataFrame) -> DataFrame:
    """(label_a, label_b) of the pairs of texts whose weighted Jaccard reaches the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            n = batch.num_rows
            counts = []
            for side in (2, 3):
                doc, element, weight = weighted_shingles(batch.column(side))
                counts.append(((doc.astype(np.uint64) << np.uint64(48)) | element, weight))
            (one, w1), (two, w2) = counts
            _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
            pair = (one[i] >> np.uint64(48)).astype(np.int64)
            least = np.bincount(pair, np.minimum(w1[i], w2[j]), n)
            both = sum(np.bincount((c >> np.uint64(48)).astype(np.int64), w, n) for c, w in counts)
            linked = least >= SIMILARITY * (both - least) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(linked & (least > 0)))

    return pairs.select("label_a", "label_b", "text_a", "text_b").mapInArrow(
        verify, "label_a bigint, label_b bigint"
    )


def _agreeing(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(a, b, label_a, label_b) of members and leaders of a bucket whose signatures agree well enough.

    Both have band, bucket, row, n, label, size, sketch and bands. A bucket's members are compared in chunks.
    A pair that shares several buckets is given by that of its first band only: of two documents of
    different classes one is outside the largest class of that bucket, too, and leads there in some turn.
    The first band is that of ``bands``, by which buckets are made; sketches may agree in more of them.
    """
    chunks = F.ceil(F.col("size") / CHUNK)
    width = BANDS * BAND_ROWS

    def compare(members: pa.Table, leaders: pa.Table) -> pa.Table:
        def columns(table: pa.Table) -> list[np.ndarray]:
            sketches = b"".join(table["sketch"].to_pylist())
            bands = np.concatenate([np.empty(0, np.int64), *(c.flatten().to_numpy() for c in table["bands"].chunks)])
            return [
                *(table[c].to_numpy() for c in ("row", "n", "label")),
                np.frombuffer(sketches, np.uint8).reshape(-1, width), bands.reshape(-1, BANDS),
            ]

        row, n, label, sketch, bands = columns(members)
        band = members["band"][0].as_py() if members.num_rows else 0
        found = [np.empty((0, 4), np.int64)]
        for one, size, name, own, own_bands in zip(*columns(leaders), strict=True):
            near = (label != name) & (np.minimum(n, size) >= SIMILARITY * np.maximum(n, size))
            rows = np.flatnonzero(near)
            rows = rows[(sketch[rows] == own).sum(axis=1) >= LEAST_AGREEMENT * width]
            rows = rows[(bands[rows] == own_bands).argmax(axis=1) == band]
            less = row[rows] < one
            columns_ = [
                np.where(less, row[rows], one), np.where(less, one, row[rows]),
                np.where(less, label[rows], name), np.where(less, name, label[rows]),
            ]
            found.append(np.stack(columns_, axis=1))
        return pa.table(list(np.concatenate(found).T), names=["a", "b", "label_a", "label_b"])

    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("row"), chunks))
    copied = leaders.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    columns = ["band", "bucket", "chunk", "row", "n", "label", "sketch", "bands"]
    return (
        dealt.select(columns).toDF(*columns).groupBy("bucket", "chunk")
        .cogroup(copied.select(columns).toDF(*columns).groupBy("bucket", "chunk"))
        .applyInArrow(compare, "a bigint, b bigint, label_a bigint, label_b bigint")
    )


def components(links: DataFrame) -> DataFrame:
    """(row, label) of every row with a link: the least row that it is connected with.

    Each turn joins every row's larger neighbours to its least one, then its smaller ones; stars
    around the least row of each component remain. Both steps are a grouping and a join by row.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("u").alias("row"), F.col("v").alias("label"))
        mark = seen
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u > v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "links")


def near_classes(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_key, class_id and kept of every document; a class is what links connect.

    Two documents are linked if the multisets of their shingles, runs of five words, have a weighted
    Jaccard similarity of 0.8 or more. Documents with equal multisets are one class from the start
    and go on as one. In a band, documents with equal signature rows form a bucket. A bucket compares
    its best connected document with all others. As long as its documents are not all connected, some
    of those outside its largest class then lead in turn, each compared with all that are not in its
    own class; LEADERS_GROW times as many in each turn. So no two documents of a bucket stay apart that were
    neither compared nor connected, and a large group of copies is done after its first turn.

    Documents without words are one class; a null doc_id counts as less than any other; repeated rows
    are copies of each other; an empty table gives an empty one.
    """
    signed = staged(_signed(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    multiset = ["n", "key", "key2"]
    copies = signed.groupBy(*multiset).agg(F.min("row").alias("rep"))
    member = staged(
        signed.select("row", "doc_id", "text_key", *multiset).join(copies, multiset)
        .select("row", "doc_id", "text_key", "rep"),
        "copies",
    )
    reps = signed.join(copies.select("rep"), F.col("row") == F.col("rep"), "left_semi")
    banded = reps.select("row", "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = staged(banded.join(sizes, "bucket"), "buckets")
    degree = members.groupBy("row").agg(F.sum("size").alias("degree"))
    members = staged(
        members.join(degree, "row").select("band", "bucket", "row", "n", "size", "degree", F.col("row").alias("label")),
        "members",
    )
    texts = docs.select(F.col("doc_id"), _text_key(), "text")
    wanted = member.join(members.select("row").distinct(), "row", "left_semi")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_key") == F.col("w.text_key"))
    # repeated rows have one representative and so one text, however often it comes
    texts = texts.alias("t").join(wanted.alias("w"), same).groupBy("w.row").agg(F.first("t.text").alias("text"))

    sketches = signed.join(members.select("row").distinct(), "row", "left_semi").select("row", "sketch", "bands")
    tested = members.sparkSession.createDataFrame([], "a bigint, b bigint")
    led = members.sparkSession.createDataFrame([], "bucket bigint, row bigint")
    at_once = 1
    while True:
        # documents still to lead in a bucket: those outside its largest class, at first any
        shares = members.groupBy("bucket", "label").agg(F.count("*").alias("rows"))
        largest = (
            shares.groupBy("bucket")
            .agg(F.max(F.struct("rows", "label")).alias("most"), F.count("*").alias("labels"))
            .filter("labels > 1")
            .select("bucket", F.col("most.rows").alias("rows"), F.col("most.label").alias("main"))
        )
        free = members.join(largest, "bucket").filter("label != main OR rows = 1")
        free = free.join(led, ["bucket", "row"], "left_anti")
        best = Window.partitionBy("bucket").orderBy(F.desc("degree"), "row")
        leaders = free.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= at_once)
        leaders = staged(leaders.select("band", "bucket", "row", "n", "label", "size"), "leaders")
        if leaders.isEmpty():
            break
        if at_once == 1:
            one, two = (F.struct(f"{x}.row", f"{x}.label") for x in "ml")
            near = F.least("m.n", "l.n") >= SIMILARITY * F.greatest("m.n", "l.n")
            pairs = (
                members.alias("m")
                .join(leaders.alias("l"), F.col("m.bucket") == F.col("l.bucket"))
                .filter(near & (F.col("m.label") != F.col("l.label")))
                .select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
                .select("a.row", "b.row", "a.label", "b.label")
                .toDF("a", "b", "label_a", "label_b")
            )
        else:
            led_buckets = leaders.select("bucket").distinct()
            pairs = _agreeing(
                members.join(led_buckets, "bucket", "left_semi").join(sketches, "row"),
                leaders.join(sketches.toDF("row", "sketch", "bands"), "row"),
            )
        pairs = pairs.distinct().join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        first, second = (texts.select(F.col("row").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        found = staged(_overlap(pairs.join(second, "b").join(first, "a")), "verified")
        tested = tested.unionByName(pairs.select("a", "b"))
        led = led.unionByName(leaders.select("bucket", "row"))
        at_once *= LEADERS_GROW
        if found.isEmpty():
            continue
        renamed = components(found.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        renamed = renamed.select(F.col("row").alias("label"), F.col("label").alias("renamed"))
        members = members.join(renamed, "label", "left").withColumn(
            "label", F.coalesce("renamed", "label")
        )
        members = staged(members.select("band", "bucket", "row", "n", "size", "degree", "label"), "members")
    labels = members.select(F.col("row").alias("rep"), "label").distinct()
    classed = staged(
        member.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "classes"
    )
    heads = classed.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head")
    )
    return classed.join(heads, "label").select(
        "row", "doc_id", "text_key", F.col("head.doc_id").alias("class_id"),
        (F.col("row") == F.col("head.row")).alias("kept"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept (true for one of a class)."""
    return near_classes(docs).select("doc_id", "class_id", "kept")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all its columns."""
    stay = near_classes(docs.select("doc_id", "text")).filter("kept").alias("s")
    rows = docs.select(F.struct("*").alias("row"), _text_key()).alias("r")
    same = F.col("r.row.doc_id").eqNullSafe(F.col("s.doc_id")) & (
        F.col("r.text_key") == F.col("s.text_key")
    )
    kept = rows.join(stay.select("doc_id", "text_key"), same)
    return kept.groupBy("r.row.doc_id", "r.text_key").agg(F.first("r.row").alias("one")).select("one.*")
