"""Substring dedup: repeated runs of words found in suffix groups of variable-length prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import coded_words, slices, split_words, staged, window_hashes, word_hashes

WINDOW = 13
#: Suffixes that one group should hold, about; a task sorts a group in memory.
GROUP_SUFFIXES = 3_000_000
#: Characters of one bucket of documents, about; a task holds the texts of a bucket. One that has twice as many, as
#: of rows without an id, is split.
BUCKET_CHARS = 12_000_000
#: Lengths of a prefix, in words, before it is the whole window.
PREFIXES = (1, 2, 3)
_LAST = np.int64(2**63 - 1)


def integer_ids(docs: DataFrame) -> None:
    """Raises where doc_id is no whole number: the least id keeps what repeats, so ids are compared as numbers."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"doc_id is {kind.simpleString()}; repeats are kept by the least number")


def _doc_ids(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(int(_LAST)).to_numpy(zero_copy_only=False)


def _frequent_prefixes(docs: DataFrame, groups: int) -> list[np.ndarray]:
    """Hashes of the prefixes of each length that hold a large part of a group.

    Each batch reports prefixes with more than a 16 * ``groups``-th of its words, so at most that many, and
    a prefix is taken if these counts make up an eighth of a group: at most 8 * ``groups`` of each length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, codes, words = coded_words(batch.column(0))
            hashes = word_hashes(words)[codes]
            rows = []
            for size in PREFIXES:
                found, times = np.unique(window_hashes(starts, hashes, size)[0], return_counts=True)
                many = times > len(hashes) / (16 * groups)
                rows.append((np.full(many.sum(), size), found[many].view(np.int64), times[many]))
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
            yield pa.record_batch(
                [pa.array(columns[0].astype(np.int32)), pa.array(columns[1]), pa.array(columns[2])],
                names=["size", "prefix", "times"],
            )

    least = GROUP_SUFFIXES / 8
    rows = (
        docs.select("text").mapInArrow(count, "size int, prefix bigint, times bigint")
        .groupBy("size", "prefix").agg(F.sum("times").alias("times"))
        .filter(F.col("times") >= least).toPandas()
    )
    return [
        np.sort(rows["prefix"][rows["size"] == size].to_numpy(np.int64).view(np.uint64))
        for size in PREFIXES
    ]


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _prefixes(starts: np.ndarray, words: np.ndarray, code: np.ndarray, frequent: list[np.ndarray]) -> np.ndarray:
    """Of each window the hash of its shortest prefix that is not frequent, at most of all of it."""
    lengths = np.diff(starts)
    ahead = np.arange(len(words)) - np.repeat(starts[:-1], lengths)
    left = np.repeat(lengths, lengths) - ahead
    prefix = np.empty(len(code), np.uint64)
    open_ = np.ones(len(code), bool)
    for size, many in zip(PREFIXES, frequent, strict=True):
        hashes = window_hashes(starts, words, size)[0][left[left >= size] >= WINDOW]
        prefix[open_] = hashes[open_]
        open_ &= _in(hashes, many)
    prefix[open_] = code[open_]
    return prefix


def _packed(values: np.ndarray) -> bytes:
    """Ascending integers as the first one and steps of the least width that holds them."""
    steps = np.diff(values)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or w == 8 or steps.max() < 1 << 8 * w)
    return bytes([width]) + values[:1].tobytes() + steps.astype(f"<u{width}").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, f"<u{packed[0]}", offset=9)
    first = np.frombuffer(packed, np.int64, 1, offset=1)
    return np.concatenate([first, first + np.cumsum(steps.astype(np.int64))])


def _cells(doc: np.ndarray, code: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes]]:
    """Bucket of documents, its documents in ascending order, packed, and the code that goes with each."""
    bucket = doc % buckets
    order = np.lexsort((doc, bucket))
    doc, code, bucket = doc[order], code[order], bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    ends = [*first[1:], len(doc)]
    return [
        (int(bucket[a]), _packed(doc[a:b]), code[a:b].tobytes())
        for a, b in zip(first, ends if len(first) else [], strict=True)
    ]


def _suffixes(
    docs: DataFrame, groups: int, buckets: int, frequent: list[np.ndarray]
) -> DataFrame:
    """Rows for the groups: the suffixes' codes, and their documents in ascending order, packed.

    Of equal windows in a batch only the one of the least doc_id goes to its group. The others repeat it
    already: rows with a bucket of documents carry the codes of those.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = _doc_ids(batch.column(0))
            rows = np.argsort(ids, kind="stable")
            starts, codes, words = coded_words(batch.column(1).take(pa.array(rows)))
            hashes = word_hashes(words)[codes]
            code, doc = window_hashes(starts, hashes, WINDOW)
            doc = ids[rows][doc]
            prefix = _prefixes(starts, hashes, code, frequent)
            order = np.argsort(code, kind="stable")  # equal windows by ascending doc_id
            code, doc, prefix = code[order], doc[order], prefix[order]
            first = np.append(True, code[1:] != code[:-1])[: len(code)]
            later = doc > doc[np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))]
            out = [(b % groups, b, d, c) for b, d, c in _cells(doc[later], code[later], buckets)]
            code, doc, prefix = code[first], doc[first], prefix[first]
            group = (prefix % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((doc, group))
            code, doc, group = code[order], doc[order], group[order]
            at = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else []
            for a, b in zip(at, [*at[1:], len(group)], strict=True):
                out.append((int(group[a]), None, _packed(doc[a:b]), code[a:b].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["part", "bucket", "docs", "codes"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        cut, "part bigint, bucket bigint, docs binary, codes binary"
    )


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    docs = [_unpacked(d.as_py()) for d in table["docs"]]
    codes = [np.frombuffer(c.as_py(), np.uint64) for c in table["codes"]]
    return (
        np.concatenate([np.empty(0, np.int64), *docs]),
        np.concatenate([np.empty(0, np.uint64), *codes]),
    )


def _deep_nodes(suffixes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, docs, codes): documents, by buckets, and their windows that a smaller doc_id has too.

    A group holds all suffixes under its prefixes. Sorted, those below one node of depth 13 stand together;
    the node's least document keeps the window.
    """

    def grow(group: pa.Table) -> pa.Table:
        known = group.filter(group["bucket"].is_valid()).select(["bucket", "docs", "codes"])
        doc, code = _unpack(group.filter(group["bucket"].is_null()))
        order = np.argsort(code, kind="stable")
        code, doc = code[order], doc[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        least = np.minimum.reduceat(doc, first) if len(first) else doc
        later = doc > np.repeat(least, np.diff(np.append(first, len(code))))
        cells = _cells(doc[later], code[later], buckets)
        found = [pa.array([c[i] for c in cells], known.schema.types[i]) for i in range(3)]
        return pa.concat_tables([pa.table(found, names=known.column_names), known])

    return suffixes.groupBy("part").applyInArrow(grow, "bucket bigint, docs binary, codes binary")


def _kept_words(docs: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row of ``docs``."""

    def strip(texts: pa.Table, marks: pa.Table) -> pa.Table:
        doc, code = _unpack(marks)
        order = np.argsort(doc, kind="stable")
        doc, code = doc[order], code[order]
        text, removed, sizes = [], [], []
        for own, value in zip(_doc_ids(texts["doc_id"].combine_chunks()), texts["text"], strict=True):
            words = value.as_py().encode().split() if value.is_valid else []
            there = code[np.searchsorted(doc, own) : np.searchsorted(doc, own, "right")]
            sizes.append(len(words))
            if len(there) and words:
                starts, flat = split_words(pa.array([value.as_py()]))
                hit = _in(window_hashes(starts, word_hashes(flat), WINDOW)[0], np.sort(there))
                edge = np.zeros(len(words) + 1, np.int64)
                edge[: len(hit)] += hit
                edge[WINDOW : WINDOW + len(hit)] -= hit
                words = [w for w, n in zip(words, np.cumsum(edge[:-1]), strict=True) if not n]
            removed.append(sizes[-1] - len(words))
            text.append(b" ".join(words).decode())
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(text, pa.string()),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(_LAST)))
    rows = docs.select("doc_id", "text", F.pmod(doc, F.lit(buckets)).alias("bucket"))
    rows, repeated = _split(rows, repeated)
    return (
        rows.groupBy("bucket", "part").cogroup(repeated.groupBy("bucket", "part"))
        .applyInArrow(strip, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")
    )


def _split(rows: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the part of their bucket: the rows of a heavy bucket are dealt out, its marks go to all parts.

    Rows are judged one by one, so that it does not matter which part a row is in; equal rows are dealt by where
    they are read.
    """
    sizes = rows.groupBy("bucket").agg(F.sum(F.length("text")).alias("size"))
    parts = F.ceil(F.col("size") / BUCKET_CHARS).alias("parts")
    heavy = staged(sizes.filter(F.col("size") > 2 * BUCKET_CHARS).select("bucket", parts), "heavy")
    if heavy.isEmpty():
        whole = F.lit(0).cast("long").alias("part")
        return rows.select("*", whole), repeated.select("*", whole)
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("doc_id", "text") + F.spark_partition_id(), parts).alias("part")
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    return (
        rows.join(heavy, "bucket", "left").select(*rows.columns, part),
        repeated.join(heavy, "bucket", "left").select(*repeated.columns, every),
    )


def _prime_from(least: int) -> int:
    while any(least % k == 0 for k in range(2, int(least**0.5) + 1)):
        least += 1
    return least


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document.

    A window is 13 consecutive words of one document. A word goes if a window that covers it also starts in
    a document with a smaller doc_id; the words that stay are joined by single spaces. Windows are judged
    on the input: the least doc_id keeps its text, and so does a document that repeats only itself.

    The suffixes of all documents are dealt to groups by a prefix: their first word, or the first two
    or three or all 13 where that prefix alone would fill a good part of a group. A group fits one task's
    memory. What goes is told by the nodes at depth 13, so the tree is cut there and a suffix is kept as a 64-bit
    code of its 13 words: equal codes are taken for equal windows; ``suffixes.maximal_repeats`` grows the trees
    below. Equal windows of one batch are one suffix, so that a passage of a third
    of all documents does not fill its group.

    Null and empty texts have no words; rows with the same doc_id count as one document and keep what they share;
    a null doc_id comes after all others. doc_id must be a whole number. An empty table gives an empty one.
    """
    integer_ids(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    groups = int(max(6, (chars or 0) // (6 * GROUP_SUFFIXES)))
    buckets = _prime_from(max(7, (chars or 0) // BUCKET_CHARS))  # a prime deals out ids in steps, too
    frequent = _frequent_prefixes(docs, groups)
    suffixes = _suffixes(docs, groups, buckets, frequent)
    repeated = staged(_deep_nodes(suffixes, buckets), "repeated")
    return _kept_words(docs.select("doc_id", "text"), repeated, buckets)


def repeats_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; see ``without_repeats``."""
    kept = without_repeats(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
