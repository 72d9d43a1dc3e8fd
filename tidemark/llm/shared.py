"""What several operators use: staged tables, words of a text, chunks of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.session import shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the folder that all executors share and read back: its lineage ends there.

    That folder is ``spark.checkpoint.dir``; without it this raises. What is written stays, as the result is
    read from it: whoever owns the folder empties it after the job.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_within(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``staged`` for a block: what is written is deleted at its end, so nothing may be read from it later."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether the document is kept out of learning: crc32 of its id as text, modulo ``modulus``."""
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return crc % modulus == 0


def slices(batches: Iterable[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * min(1.0, limit / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of all texts in order, and where each text's words begin in them (one more at the end).

    A null text has none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    pieces = pc.ascii_split_whitespace(texts)
    ends = pieces.offsets.to_numpy().astype(np.int64)
    flat = pieces.values.slice(ends[0], ends[-1] - ends[0])
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return before[ends - ends[0]], flat.filter(full)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Like ``split_words``, with the words as numbers into an array of the different words."""
    starts, words = split_words(texts)
    coded = words.dictionary_encode()
    return starts, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random number for each byte at each place."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    out = np.zeros(len(words), np.uint64)
    if len(data):
        place = np.arange(len(data)) - np.repeat(starts, np.diff(ends))
        values = mixed((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1))
        full = np.diff(ends) > 0
        out[full] = np.add.reduceat(values, starts[full])
    return mixed(out)


def window_hashes(
    starts: np.ndarray, words: np.ndarray, size: int, short: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one document, and each window's document.

    ``words`` are the hashes of all documents' words. With ``short``, a document of fewer words than
    that, but one at least, counts as one window.
    """
    lengths = np.diff(starts)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ahead = np.arange(len(words)) - np.repeat(starts[:-1], lengths)
    left = np.repeat(lengths, lengths) - ahead
    wanted = left >= size
    if short:
        wanted |= (ahead == 0) & (left < size)
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        total *= np.uint64(0x9E3779B97F4A7C15)
        there = words[k:] if k else words
        if short:
            there = np.where(left[: len(there)] > k, there, np.uint64(0))
        total[: len(there)] += there
    return mixed(total[wanted]), doc[wanted]
