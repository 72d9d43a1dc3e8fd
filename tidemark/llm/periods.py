"""Periodic runs of words in documents, found by seeds on diagonals, and texts without their repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, coded_words, mixed, slices, window_hashes

#: A run has so many words at least, and so many times its period.
LEAST_WORDS, LEAST_REPEATS = 24, 3
#: Words of a seed for periods up to 8: a run of period q repeats max(24 - q, 2 q) words or more at distance q.
SEED, SHORT = 16, 8


def _repeated(names: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New names from 0 and positions of those whose name occurs twice or more, by name, then position."""
    order = np.argsort(names, kind="stable")
    names, positions = names[order], positions[order]
    new = np.append(True, names[1:] != names[:-1]) if len(names) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1 if len(names) else new
    return number[often], positions[often]


def _first_names(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and positions of the seeds that occur twice or more in their document, by name and position.

    Hashes leave out the others; what they hold together is compared word by word.
    """
    position = np.arange(len(codes))
    lengths = np.diff(starts)
    position = position[np.repeat(starts[1:], lengths) - position >= SEED]
    hashes, doc = window_hashes(starts, mixed(codes.astype(np.uint64) + np.uint64(1)), SEED)
    hashes = hashes + mixed(doc.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    slot = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    hit = twice[slot] == hashes
    names, positions = _repeated(slot[hit], position[hit])
    pair = np.flatnonzero(names[1:] == names[:-1])
    one, two = positions[pair], positions[pair + 1]
    alike = doc[np.searchsorted(position, one)] == doc[np.searchsorted(position, two)]
    for k in range(SEED):
        alike &= codes[one + k] == codes[two + k]
    if not alike.all():  # two seeds share a hash: name them by their words
        whose = np.repeat(np.arange(len(lengths)), lengths)[positions]
        rows = np.column_stack([whose, codes[positions[:, None] + np.arange(SEED)]])
        exact = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(positions)
        names, positions = _repeated(exact[order], positions[order])
    return names, positions


def _joined(
    names: np.ndarray, positions: np.ndarray, ahead: int, words: int
) -> tuple[np.ndarray, np.ndarray]:
    """Names of longer stretches: those of two named ones, ``ahead`` apart; only repeated ones are kept."""
    named = np.full(words + ahead, -1, np.int64)
    named[positions] = names
    order = np.sort(positions)
    order = order[named[order + ahead] >= 0]
    return _repeated(named[order] * (named.max(initial=0) + 1) + named[order + ahead], order)


def _matching(left: np.ndarray, right: np.ndarray) -> int:
    """How many values at the begin of both are equal, compared in growing steps."""
    at, step, most = 0, 64, min(len(left), len(right))
    while at < most:
        same = left[at : at + step] == right[at : at + step]
        if not same.all():
            return at + int(np.argmin(same))
        at, step = min(most, at + step), step * 2
    return most


def runs_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of the texts that lie one after another, by start, then period.

    ``codes`` are the words' numbers, ``starts`` where each text begins, and the end.

    Periods are looked for class by class. In a class from ``low`` to ``4/3 low``, runs repeat ``k = 2 low``
    words or more (16 up to period 8). Such a stretch of k words has the run's period q; were it found
    again at a distance d < q, then at q - d as well, and the smaller of the two plus q is at most
    k, so that the stretch and the run had a period dividing q. So a run with least period q shows as
    two successive occurrences of a stretch at distance q, and pairs further apart need no look. For the
    same reason a distance between successive occurrences is the least period of a long enough run.
    Each pair is extended on its diagonal both ways, unless its diagonal is covered that far already.
    """
    found: list[tuple[int, int, int]] = []
    longest = int(np.diff(starts).max(initial=0))
    names, positions = _first_names(codes, starts)
    size, low, high, k = SEED, 1, SHORT, SEED
    while low <= longest // LEAST_REPEATS and len(positions):
        while 2 * size <= k:
            names, positions = _joined(names, positions, size, len(codes))
            size *= 2
        seeds, at = (names, positions) if k == size else _joined(names, positions, k - size, len(codes))
        gap = at[1:] - at[:-1]
        good = (seeds[1:] == seeds[:-1]) & (gap >= low) & (gap <= high)
        lag, place = gap[good], at[:-1][good]
        order = np.lexsort((place, lag))
        lag, place = lag[order], place[order]
        if len(lag):
            first = np.append(True, (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1))
            covered: dict[int, int] = {}
            for q, i in zip(lag[first].tolist(), place[first].tolist(), strict=True):
                if i < covered.get(q, 0):
                    continue
                text = np.searchsorted(starts, i, side="right")
                begin, end = int(starts[text - 1]), int(starts[text])
                right = i + _matching(codes[i : end - q], codes[i + q : end])
                left = i - _matching(codes[begin:i][::-1], codes[begin + q : i + q][::-1])
                covered[q] = right
                length = right - left + q
                if length >= max(LEAST_WORDS, LEAST_REPEATS * q):
                    found.append((left, length, q))
        low = high + 1
        high, k = 4 * low // 3, 2 * low
    ordered = np.array(sorted(set(found), key=lambda run: (run[0], run[2])), np.int64).reshape(-1, 3)
    return ordered[:, 0], ordered[:, 1], ordered[:, 2]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs and collapsed (the text without repeats) of every document.

    ``runs`` are (start, length, period) in words from 0: stretches whose words q apart are equal, q being
    their least period, of 24 words or more and three times q or more, that no word next to them extends.
    ``collapsed`` are the words, joined by one space, that no run holds after its first q words.

    A null or empty text, and one of blanks, has no runs and is empty when collapsed. Repeated rows are
    each looked at, doc_id may be null or of any type, other columns are not read, an empty table gives an
    empty one. A text is held by one task, with about 200 bytes for each of its words.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            texts = batch.column(1)
            starts, codes, _ = coded_words(texts)
            start, length, period = runs_of(codes, starts)
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            kept = np.cumsum(gone)[:-1] == 0
            of_text = np.searchsorted(start, starts)
            collapsed = []
            for nth, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                words = (text or b"").split()
                if of_text[nth] < of_text[nth + 1]:
                    here = kept[starts[nth] : starts[nth + 1]]
                    words = [word for word, keep in zip(words, here.tolist(), strict=True) if keep]
                collapsed.append(b" ".join(words))
            whose = np.searchsorted(starts, start, side="right") - 1
            runs = pa.StructArray.from_arrays(
                [pa.array(start - starts[whose]), pa.array(length), pa.array(period)],
                names=["start", "length", "period"],
            )
            lists = pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), runs)
            yield pa.record_batch(
                [batch.column(0), lists, pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def collapsed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with (doc_id, text) only, the text being the collapsed one; a null text becomes empty."""
    return periodic_runs(docs).select("doc_id", F.col("collapsed").alias("text"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where the texts of one in ten documents repeat a part of theirs up to the end.

    Which, where from and how long a part is follows from the crc32 of the doc_id as text (null: the empty
    one). The words of such a text are joined by one space; a null text counts as empty.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), (crc % 10 == 0).alias("chosen"), F.floor(crc / 10).alias("g"))
    words = F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    first = (F.col("g") % F.greatest("n", F.lit(1))).cast("int")
    part = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    rows = rows.withColumn("a", first).withColumn("p", part.cast("int"))
    return rows.select("doc_id", F.when(F.col("n") > 0, _repeating()).otherwise(F.col("text")).alias("text"))


def _repeating() -> Column:
    """The first ``a`` of ``words`` and then the next ``p`` over and over, ``n`` in all."""
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    part = F.slice("words", F.col("a") + 1, F.col("p"))
    words = F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(part, times)))
    return F.array_join(F.slice(words, F.lit(1), F.col("n")), " ")


def runs_digest(docs: DataFrame) -> DataFrame:
    """Of every document: its runs' number and digest, its run of most repeats, the collapsed text's digest.

    The run of most repeats has the greatest quotient of length and period, compared without rounding, then
    the least start, then the least period; without runs its columns are null.
    """
    runs = periodic_runs(docs)
    better = lambda most, run: F.when(
        run["length"] * most["period"] > most["length"] * run["period"], run
    ).otherwise(most)
    best = F.reduce("runs", F.get("runs", F.lit(0)), better)
    line = lambda run: F.concat_ws(",", *(run[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))), "")
    found = runs.select("doc_id", "runs", best.alias("best"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
