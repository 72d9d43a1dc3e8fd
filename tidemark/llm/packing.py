"""Packing documents into sequences: best-fit decreasing, with lower bounds that certify it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, staged
from tidemark.llm.tokens import WordEndTokenizer, encode

CAPACITY = 2048
#: Pieces that one task packs, about.
GROUP_ROWS = 40_000
#: Exchanges of documents at most; each must lower the number of sequences to be followed by another.
EXCHANGES = 6


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces of its ids, then id 0.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. White space parts
    words there, so each different word of a batch is encoded once.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordEndTokenizer(tokenizer)
        for batch in slices(batches, 16 << 20):
            ids, starts = encode(batch.column(1), ids_of, 0)
            n = -(-np.diff(starts) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = starts[row] + piece * capacity
            end = np.minimum(begin + capacity, starts[row + 1])
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin, end, strict=True)]
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(piece.astype(np.int64) * capacity),
                    pa.array((end - begin).astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that items of these sizes need at least, by dual feasible functions.

    Such a function maps sizes to sizes so that what fits a sequence still fits; the mapped total
    over the capacity is a bound. Families: with a threshold t, sizes above capacity - t count as
    full and those below t as nothing (t = 0 is the plain total); with a number k, sizes are rounded
    to multiples of capacity / k.
    """
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.float64)
    size = np.arange(capacity + 1)
    total, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(capacity // 2 + 1)
    above = number[-1] - number[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = np.max(np.ceil((above * capacity + middle) / capacity - 1e-9))
    for k in range(1, 101):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        mapped = np.where(exact, size * k, (scaled // capacity) * capacity)
        best = max(best, np.ceil((count @ mapped) / (k * capacity) - 1e-9))
    return int(best)


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item: largest first, each where least room is left over."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by the room they have
    roomy = 0  # bit r is set where some sequence has room r
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = roomy >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                roomy &= ~(1 << room)
        else:
            room, at, used = capacity, used, used + 1
        sequence[item], offset[item] = at, capacity - room
        if room > size:
            open_[room - size].append(at)
            roomy |= 1 << (room - size)
    return sequence, offset


def _packed(pieces: DataFrame, groups: int, attempt: int, capacity: int) -> DataFrame:
    """Pieces with sequence_id, offset and whether they go into the next exchange.

    Pieces are dealt at random to groups of bounded size, each packed in one task. Where a group's
    bound equals its number of sequences the packing is certified, and only its emptiest sequence
    goes on, to be joined with others' remains; elsewhere all sequences with room do.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        sizes = group["length"].to_numpy()
        sequence, offset = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(sequence, weights=sizes)
        certified = len(filled) == lower_bound(sizes, capacity)
        again = filled < capacity
        if certified:
            again &= np.arange(len(filled)) == np.argmin(filled)
        first = (attempt << 52) + (int(group["part"].iloc[0]) << 24)
        return group.assign(
            sequence_id=first + sequence, offset=offset, again=again[sequence], certified=certified
        ).drop(columns="part")

    part = F.pmod(F.xxhash64("item", F.lit(attempt)), F.lit(groups))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return (
        pieces.withColumn("part", part)
        .groupBy("part")
        .applyInPandas(
            pack, f"{kinds}, sequence_id bigint, offset bigint, again boolean, certified boolean"
        )
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
    exchanges: int = EXCHANGES,
) -> DataFrame:
    """Documents packed into as few sequences as found: see the columns of ``token_pieces``.

    Adds sequence_id, offset and certified (its group's count of sequences meets the lower bound).
    Pieces are packed in groups by best-fit decreasing; groups whose count exceeds their lower bound
    exchange the documents of sequences with room and pack them again, as long as that saves any.
    A null or empty text is the single id 0; repeated rows are packed each; other columns of ``docs``
    are not looked at; an empty table gives an empty one.
    """
    pieces = token_pieces(docs, tokenizer, capacity)
    pieces = staged(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    count = pieces.count()
    packed = staged(_packed(pieces, -(-count // group_rows) or 1, 0, capacity), "packed")
    settled, columns = [], pieces.columns
    for attempt in range(1, exchanges + 1):
        open_ = packed.filter("again")
        rows, before = open_.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        if before < 2:
            break
        again = staged(
            _packed(open_.select(columns), -(-rows // group_rows), attempt, capacity), "packed"
        )
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= before:
            break
        settled.append(packed.filter(~F.col("again")))
        packed = again
    for part in settled:
        packed = packed.unionByName(part)
    return packed.drop("item", "again")
