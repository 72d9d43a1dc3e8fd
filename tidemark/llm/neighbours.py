"""Approximate nearest neighbours by several shifted Hilbert orders of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.shared import mixed, staged

NEAREST = 20
CURVES, AXES, BITS = 6, 4, 8
#: Share of the true neighbours of the fitting queries that the windows must hold, and their number.
RECALL, FIT_QUERIES = 0.96, 64
#: Vectors of a block of a curve, and queries of a span of it that a block meets, about.
BLOCK, QUERY_CHUNK = 4096, 2048
#: Scores that a task holds at once, and bytes found by all blocks for the queries that are merged together, about.
CELLS, MERGED_BYTES = 1 << 19, 8 << 20


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point, of unsigned coordinates of so many bits, on the Hilbert curve.

    The usual transposition: undo the turns and mirrors of each level, then Gray-code, then interleave.
    """
    x = points.astype(np.int64).T.copy()
    level = 1 << (bits - 1)
    while level > 1:
        for axis in range(len(x)):
            on = (x[axis] & level) != 0
            swap = np.where(on, 0, (x[0] ^ x[axis]) & (level - 1))
            x[0] ^= np.where(on, level - 1, swap)
            x[axis] ^= swap
        level >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = (key << 1) | ((x[axis] >> bit) & 1)
    return key


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Packed vectors as doubles; those of single precision are packed as such."""
    packed = b"".join(column.to_pylist())
    kind = np.float32 if len(packed) == 4 * size * len(column) else np.float64
    return np.frombuffer(packed, kind).reshape(-1, size).astype(np.float64, copy=False)


def _usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(row, vec_id, vec, norm) of the vectors that take part, vec as floats or doubles in binary; their length."""
    numbers = F.col("embedding").cast("array<double>")
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = vectors.filter(F.col("embedding").isNotNull() & fine & F.exists(numbers, lambda x: x != 0))
    sizes = some.groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").first()
    if most is None:
        return some.select("vec_id").filter("false"), 0
    size = most["size"]
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            packed = [row.tobytes() for row in (flat.astype(np.float32) if single else flat)]
            yield pa.record_batch(
                [batch.column(0), pa.array(packed, pa.binary()), pa.array(np.linalg.norm(flat, axis=1))],
                names=["vec_id", "vec", "norm"],
            )

    packed = some.filter(F.size("embedding") == size).select("vec_id", numbers.alias("embedding"))
    packed = packed.mapInArrow(pack, "vec_id bigint, vec binary, norm double")
    return staged(packed.withColumn("row", F.monotonically_increasing_id()), "vectors"), size


def _best(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` best of each query: greatest score, then least vec_id."""
    order = np.lexsort((vec_id, -score, query))
    query = query[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return order[place < k]


def _scores(
    queries: np.ndarray, vectors: np.ndarray, allowed: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and vector numbers and inner products of the ``k`` best allowed vectors, ties of the last kept."""
    score = np.where(allowed, queries @ vectors.T, -np.inf)
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        q, v = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    else:
        q, v = np.nonzero(np.isfinite(score))
    return q, v, score[q, v]


def exact_neighbours(vectors: DataFrame, size: int, queries: list, k: int = NEAREST) -> DataFrame:
    """(query, near, vec_id, score): the ``k`` nearest rows of a bounded list of query rows, by brute force."""
    wanted = _matrix(pa.array([bytes(q["vec"]) for q in queries], pa.binary()), size)
    rows = np.array([q["row"] for q in queries], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, vec_id = (batch.column(i).to_numpy() for i in (0, 1))
            q, v, score = _scores(wanted, _matrix(batch.column(2), size), rows[:, None] != row[None], k)
            yield pa.record_batch(
                [pa.array(a) for a in (rows[q], row[v], vec_id[v], score)],
                names=["query", "near", "vec_id", "score"],
            )

    found = vectors.select("row", "vec_id", "vec").mapInArrow(
        scan, "query bigint, near bigint, vec_id bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _places(vectors: DataFrame, size: int) -> DataFrame:
    """(row, curve, place): the order of all vectors on each curve, by a range sort of their keys.

    A vector gets one more component, so that all are as long as the longest: for vectors of one length near
    then means a large inner product. Each curve projects them on a few random axes, shifts and scales
    these by their mean and spread, and takes the Hilbert order of the cells.
    """
    longest = vectors.agg(F.max("norm")).first()[0]
    random = np.random.default_rng(6)
    axes = np.concatenate(
        [np.linalg.qr(random.standard_normal((size + 1, min(AXES, size + 1))))[0] for _ in range(CURVES)], axis=1
    )
    width = axes.shape[1] // CURVES
    shifts = random.random((CURVES, width))

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        more = np.sqrt(np.maximum(longest**2 - batch.column(2).to_numpy() ** 2, 0))
        return np.column_stack([_matrix(batch.column(1), size), more]) @ axes

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = projected(batch)
            axis = np.arange(x.shape[1])
            yield pa.record_batch(
                [pa.array(axis), pa.array(np.full(len(axis), float(len(x)))), pa.array(x.sum(0)), pa.array((x**2).sum(0))],
                names=["axis", "n", "one", "two"],
            )

    columns = vectors.select("row", "vec", "norm")
    sums = columns.mapInArrow(moments, "axis bigint, n double, one double, two double")
    sums = sums.groupBy("axis").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")]).orderBy("axis").toPandas()
    mean = (sums["one"] / sums["n"]).to_numpy()
    spread = np.sqrt(np.maximum((sums["two"] / sums["n"]).to_numpy() - mean**2, 1e-18))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (projected(batch) - mean) / spread / 6 + 0.5  # three spreads to either side
            keys = []
            for curve in range(CURVES):
                part = x[:, curve * width : (curve + 1) * width] + (shifts[curve] - 0.5) / 4
                keys.append(hilbert_keys(np.clip(part * (1 << BITS), 0, (1 << BITS) - 1)))
            yield pa.record_batch(
                [
                    pa.array(np.tile(batch.column(0).to_numpy(), CURVES)),
                    pa.array(np.repeat(np.arange(CURVES, dtype=np.int32), len(x))),
                    pa.array(np.concatenate(keys)),
                ],
                names=["row", "curve", "key"],
            )

    keys = columns.mapInArrow(keyed, "row bigint, curve int, key bigint")
    at = staged(
        keys.orderBy("curve", "key", "row").withColumn("at", F.monotonically_increasing_id()).drop("key"), "order"
    )
    part = F.shiftright("at", 33)
    counts = at.groupBy(part.alias("part"), "curve").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(
        Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    placed = at.withColumn("part", part).join(counts, ["part", "curve"])
    return staged(placed.select("row", "curve", (F.col("before") + F.col("at") - F.col("first")).alias("place")), "places")


def _window(vectors: DataFrame, size: int, places: DataFrame, is_query: str, k: int) -> int:
    """How far to look along every curve, to find ``RECALL`` of the true neighbours of some queries.

    It is ``k`` at least, so that a query finds ``k`` vectors, or all there are, on any one curve.

    At most ``FIT_QUERIES`` queries, those with the least hash, are searched by brute force. All rows are
    on the curves; this sets the width of the windows only.
    """
    some = vectors.filter(is_query).orderBy(F.xxhash64("vec_id"), "row").limit(FIT_QUERIES)
    queries = some.select("row", "vec").collect()
    pairs = exact_neighbours(vectors, size, queries, k).select("query", "near")
    far = (
        pairs.join(places.withColumnRenamed("row", "query"), "query")
        .join(places.selectExpr("row AS near", "curve", "place AS near_place"), ["near", "curve"])
        .groupBy("query", "near")
        .agg(F.min(F.abs(F.col("place") - F.col("near_place"))).alias("far"))
        .collect()
    )
    if not far:
        return k
    return max(k, int(np.quantile([r["far"] for r in far], RECALL, method="higher")) + 1)


def _met(
    places: DataFrame, usable: DataFrame, is_query: str, window: int, count: int
) -> tuple[DataFrame, DataFrame]:
    """Vectors by (curve, block, span), and queries by those that their window meets.

    A block is BLOCK consecutive vectors of a curve, a span as many as hold QUERY_CHUNK queries on
    average. A vector is copied for the spans within the window of its block only, a query for the blocks
    within its own window; both numbers follow the window, not the number of vectors.
    """
    queries = usable.filter(is_query).select("row", "vec_id", "vec")
    span = BLOCK * max(1, QUERY_CHUNK * count // max(1, queries.count()) // BLOCK)
    last = count - 1

    def over(first: Column, end: Column, size: int) -> Column:
        first, end = F.greatest(first, F.lit(0)), F.least(end, F.lit(last))
        return F.explode(F.sequence(F.floor(first / size), F.floor(end / size)))

    place, block = F.col("place"), F.floor(F.col("place") / BLOCK)
    names = ["curve", "block", "span", "row", "place", "vec_id", "vec"]
    spans = over(block * BLOCK - window, block * BLOCK + (BLOCK - 1 + window), span)
    members = places.join(usable.select("row", "vec_id", "vec"), "row")
    members = members.select("curve", block.alias("block"), spans.alias("span"), "row", "place", "vec_id", "vec")
    blocks = over(place - window, place + window, BLOCK)
    visits = queries.join(places, "row").select(
        "curve", blocks.alias("block"), F.floor(place / span).alias("span"), "row", "place", "vec_id", "vec"
    )
    return members.toDF(*names), visits.toDF(*names)


def nearest(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of each query, by inner product in doubles.

    ``vectors`` has vec_id and embedding; queries are the rows where the condition ``is_query`` holds,
    candidates all other rows. Every curve is cut into blocks of consecutive vectors; a query visits the blocks within the
    window around its own place, ranks their vectors exactly, and merges what all blocks of all curves gave.

    Vectors that are null, zero, or hold a null or a non-finite component take no part, nor do those
    of another length than most. Of equal scores the smaller vec_id comes first; repeated rows are found
    each, and each is a query where one is. Every query finds ``k`` vectors, or all others if they are
    fewer. Other columns are not read, and an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    usable, size = _usable(vectors)
    if not size:
        return spark.createDataFrame([], schema)
    places = _places(usable, size)
    count = usable.count()
    window = _window(usable, size, places, is_query, k)
    members, visits = _met(places, usable, is_query, window, count)
    # every block that a query meets gives as many as k, of five numbers each
    most = 40 * k * CURVES * (2 * window // BLOCK + 2)
    chunks = -(-usable.filter(is_query).count() * most // MERGED_BYTES) or 1

    def visit(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        packed = {"chunk": [], "found": []}
        if vectors.num_rows and queries.num_rows:
            row, place, vec_id = (vectors[c].to_numpy() for c in ("row", "place", "vec_id"))
            near = _matrix(vectors["vec"], size)
            mine, here, query = (queries[c].to_numpy() for c in ("row", "place", "vec_id"))
            wanted = _matrix(queries["vec"], size)
            chunk = (mixed(mine) % np.uint64(chunks)).astype(np.int64)
            order, step = np.argsort(chunk, kind="stable"), max(1, CELLS // len(row))
            for start in range(0, len(order), step):
                some = order[start : start + step]
                allowed = (np.abs(here[some, None] - place[None]) <= window) & (mine[some, None] != row[None])
                q, v, score = _scores(wanted[some], near, allowed, k)
                best = _best(q, vec_id[v], score, k)
                q, v, score = some[q[best]], v[best], score[best]
                columns = np.stack([mine[q], query[q], row[v], vec_id[v], score.view(np.int64)])
                of, first = np.unique(chunk[q], return_index=True)
                packed["chunk"].extend(of)
                packed["found"].extend(x.tobytes() for x in np.split(columns, first[1:], axis=1)[: len(of)])
        return pa.table(
            {"chunk": pa.array(packed["chunk"], pa.int64()), "found": pa.array(packed["found"], pa.binary())}
        )

    def merge(found: pa.Table) -> pa.Table:
        columns = [[np.empty(0, np.int64)] for _ in range(4)] + [[np.empty(0)]]
        for blob in found["found"]:
            parts = np.frombuffer(blob.as_py(), np.int64).reshape(5, -1)
            for column, part in zip(columns, [*parts[:4], parts[4].view(np.float64)], strict=True):
                column.append(part)
        row, query, near, vec_id, score = (np.concatenate(c) for c in columns)
        once = np.lexsort((near, row))
        same = (row[once][1:] == row[once][:-1]) & (near[once][1:] == near[once][:-1])
        once = once[np.append(True, ~same)[: len(once)]]
        row, query, vec_id, score = (a[once] for a in (row, query, vec_id, score))
        best = _best(row, vec_id, score, k)
        row, query, vec_id, score = (a[best] for a in (row, query, vec_id, score))
        first = np.append(True, row[1:] != row[:-1])[: len(row)]
        at = np.arange(len(row))
        rank = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
        return pa.table(
            {"query_id": query, "rank": pa.array(rank, pa.int32()), "vec_id": vec_id, "score": score}
        )

    keys = ["curve", "block", "span"]
    found = members.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(visit, "chunk bigint, found binary")
    return found.groupBy("chunk").applyInArrow(merge, schema)
