"""Maximal repeats of all documents, from suffix trees over parts of the suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repeats import GROUP_SUFFIXES, WINDOW, _frequent_prefixes, _prefixes, integer_ids
from tidemark.llm.shared import WORD, split_words, staged, window_hashes, word_hashes
from tidemark.llm.tokens import spread

#: Characters of a chunk of documents, about; a task holds a chunk.
CHUNK_CHARS = 3_000_000
_LEAST, _MOST = np.uint64(0), np.uint64(2**64 - 1)
_RECORD = ("count", "low", "high", "doc", "key", "start")


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def _before(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each place, twice; the least and the greatest number where a text begins.

    Places have different words before them if the least of the ones is not the greatest of the others. A
    text's begin differs from all, as nothing can be put before it.
    """
    low, high = np.empty_like(words), np.empty_like(words)
    low[1:] = high[1:] = words[:-1]
    first = starts[:-1][np.diff(starts) > 0]
    low[first], high[first] = _LEAST, _MOST
    return low, high


def _blobs(columns: list[np.ndarray], part: np.ndarray, more: dict | None = None) -> dict[str, list]:
    """The columns, as bytes, of each value of ``part``."""
    order = np.argsort(part, kind="stable")
    first = _runs(part[order])
    ends = np.append(first, len(part))[1:]
    cut = [[c[order][a:b].tobytes() for a, b in zip(first, ends, strict=True)] for c in columns]
    return {"part": part[order][first].tolist(), **{f"c{i}": c for i, c in enumerate(cut)}, **(more or {})}


def _column(blobs: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype)


def _chunk(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, keys, starts and word hashes of the different documents of a chunk, by id."""
    ids = table["doc_id"].combine_chunks().cast(pa.int64()).fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
    keys = table["key"].to_numpy()
    kept = np.unique(keys, return_index=True)[1]
    kept = kept[np.lexsort((keys[kept], ids[kept]))]
    starts, words = split_words(table["text"].combine_chunks().take(pa.array(kept, pa.int64())))
    return ids[kept], keys[kept], starts, word_hashes(words)


def _asked(chunks: DataFrame, groups: int, frequent: list[np.ndarray]) -> DataFrame:
    """(part, chunk, ...): the different windows of a chunk, how often they come and what stands before them."""

    def ask(table: pa.Table) -> pa.Table:
        _, _, starts, words = _chunk(table)
        code = window_hashes(starts, words, WINDOW)[0]
        prefix = _prefixes(starts, words, code, frequent)
        place = _window_places(starts)
        low, high = _before(words, starts)
        order = np.argsort(code, kind="stable")
        first = _runs(code[order])
        sizes = np.diff(np.append(first, len(code)))
        least = np.minimum.reduceat(low[place][order], first) if len(first) else low[:0]
        most = np.maximum.reduceat(high[place][order], first) if len(first) else high[:0]
        part = (prefix[order][first] % np.uint64(groups)).astype(np.int64)
        rows = _blobs([code[order][first], sizes.astype(np.int64), least, most], part)
        rows["chunk"] = [table["chunk"][0].as_py()] * len(rows["part"])
        return pa.table(
            [pa.array(rows["part"], pa.int64()), pa.array(rows["chunk"], pa.int64()), *[pa.array(rows[f"c{i}"], pa.binary()) for i in range(4)]],
            names=["part", "chunk", "codes", "sizes", "low", "high"],
        )

    return chunks.groupBy("chunk").applyInArrow(
        ask, "part bigint, chunk bigint, codes binary, sizes binary, low binary, high binary"
    )


def _window_places(starts: np.ndarray) -> np.ndarray:
    """Where each window begins."""
    lengths = np.maximum(np.diff(starts) - WINDOW + 1, 0)
    return spread(starts[:-1], lengths)


def _answered(asked: DataFrame) -> DataFrame:
    """(chunk, codes, open): of each chunk's windows those that come twice or more, and which of them have
    different words before them."""

    def answer(table: pa.Table) -> pa.Table:
        code, sizes, low, high = (
            _column(table[n], t) for n, t in (("codes", np.uint64), ("sizes", np.int64), ("low", np.uint64), ("high", np.uint64))
        )
        order = np.argsort(code, kind="stable")
        first = _runs(code[order])
        count = np.add.reduceat(sizes[order], first)
        different = np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)
        number = np.empty(len(code), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        out = {"chunk": [], "codes": [], "open": []}
        at = 0
        for chunk, blob in zip(table["chunk"].to_pylist(), table["codes"].to_pylist(), strict=True):
            own = slice(at, at + len(blob) // 8)
            at = own.stop
            often = count[number[own]] > 1
            out["chunk"].append(chunk)
            out["codes"].append(code[own][often].tobytes())
            out["open"].append(different[number[own]][often].astype(np.uint8).tobytes())
        return pa.table([pa.array(out["chunk"], pa.int64()), pa.array(out["codes"], pa.binary()), pa.array(out["open"], pa.binary())], names=list(out))

    return asked.groupBy("part").applyInArrow(answer, "chunk bigint, codes binary, open binary")


def _suffixes(chunks: DataFrame, answers: DataFrame, groups: int, frequent: list[np.ndarray]) -> DataFrame:
    """(part, words, lengths, ...): suffixes, up to the end of what repeats, that may begin a maximal repeat.

    Those are where a repeated window has different words before it somewhere. Equal suffixes of a chunk are
    one, with their number, the documents they are in, and the first place.
    """

    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        ids, keys, starts, words = _chunk(table)
        codes, opened = _column(known["codes"], np.uint64), _column(known["open"], np.uint8)
        order = np.argsort(codes)
        codes, opened = codes[order], opened[order]
        code, doc = window_hashes(starts, words, WINDOW)
        place = _window_places(starts)
        prefix = _prefixes(starts, words, code, frequent)
        slot = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
        hit = codes[slot] == code if len(codes) else np.zeros(len(code), bool)
        # the last window of each unbroken stretch of repeated windows of one document
        after = np.append(hit[1:] & (doc[1:] == doc[:-1]), False) if len(hit) else hit
        last = np.where(hit & ~after, np.arange(len(hit)), len(hit))
        last = np.minimum.accumulate(last[::-1])[::-1] if len(last) else last
        begin = np.flatnonzero(hit & (opened[slot] == 1)) if len(codes) else np.empty(0, np.int64)
        length = last[begin] - begin + WINDOW
        low, high = _before(words, starts)
        at = place[begin]
        rows: dict[bytes, list] = {}
        for b, i, n in zip(begin.tolist(), at.tolist(), length.tolist(), strict=True):
            own = rows.get(suffix := words[i : i + n].tobytes())
            if own is None:  # the first place, as documents come by their ids
                d = doc[b]
                part = int(prefix[b] % np.uint64(groups))
                rows[suffix] = [1, int(low[i]), int(high[i]), int(ids[d]), int(keys[d]), int(i - starts[d]), part]
            else:
                own[0] += 1
                own[1], own[2] = min(own[1], int(low[i])), max(own[2], int(high[i]))
        columns = {n: [row[k] for row in rows.values()] for k, n in enumerate(_RECORD)}
        for name in ("low", "high"):
            columns[name] = np.array(columns[name], np.uint64).view(np.int64)
        return pa.table(
            [
                pa.array([row[-1] for row in rows.values()], pa.int64()),
                pa.array(list(rows), pa.binary()),
                *[pa.array(columns[n], pa.int64()) for n in _RECORD],
            ],
            names=["part", "words", *_RECORD],
        )

    schema = "part bigint, words binary, " + ", ".join(f"{n} bigint" for n in _RECORD)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, schema)


def grow(sequences: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(depth, leaves) of the inner nodes of the tree of the sequences; an end differs from all else.

    The tree grows level by level: leaves that agree so far stand together, in the order of their words; where
    the next word parts them, or one of them ends, is a node. Leaves that stand alone are done.
    """
    lengths = np.array([len(s) for s in sequences], np.int64)
    flat = np.concatenate([np.empty(0, np.uint64), *sequences])
    begin = np.cumsum(lengths) - lengths
    leaf, group, depth = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), 0
    nodes = []
    while len(leaf):
        ended = lengths[leaf] == depth
        word = flat[np.minimum(begin[leaf] + depth, max(0, len(flat) - 1))]
        if not ended.any() and (word == word[_runs(group)][group - group[0]]).all():
            depth += 1
            continue
        order = np.lexsort((word, ended, group))
        leaf, group, ended, word = leaf[order], group[order], ended[order], word[order]
        same = np.append(False, (group[1:] == group[:-1]) & (word[1:] == word[:-1]) & ~ended[1:] & ~ended[:-1])
        first = _runs(group)
        parts = np.add.reduceat(~same, first)
        sizes = np.diff(np.append(first, len(group)))
        for node in np.flatnonzero((parts > 1) & (sizes > 1)).tolist():
            nodes.append((depth, leaf[first[node] : first[node] + sizes[node]]))
        group = np.cumsum(~same) - 1
        alone = np.bincount(group)[group] == 1
        on = ~alone & ~ended
        leaf, depth = leaf[on], depth + 1
        group = np.unique(group[on], return_inverse=True)[1]
    return nodes


def _nodes(suffixes: DataFrame) -> DataFrame:
    """(words, occurrences, doc, key, start) of the nodes at depth 13 or more that are maximal."""
    names = ["words", "occurrences", "doc", "key", "start"]

    def build(table: pa.Table) -> pa.Table:
        count, low, high, doc, key, start = (table[n].to_numpy() for n in _RECORD)
        low, high = low.view(np.uint64), high.view(np.uint64)
        # equal suffixes of several chunks are one leaf of several places
        different, which = np.unique(np.array(table["words"].to_pylist(), object), return_inverse=True)
        leaves = [np.frombuffer(s, np.uint64) for s in different]
        places = np.argsort(which, kind="stable")
        first = _runs(which[places])
        ends = np.append(first, len(places))[1:]
        nodes = grow(leaves)
        nodes += [(len(leaf), np.array([n])) for n, leaf in enumerate(leaves) if not _goes_on(leaves, n)]
        found = []
        for depth, own in nodes:
            members = np.concatenate([places[first[x] : ends[x]] for x in own])
            if depth >= WINDOW and count[members].sum() > 1 and low[members].min() != high[members].max():
                best = members[np.lexsort((start[members], key[members], doc[members]))[0]]
                found.append((depth, int(count[members].sum()), int(doc[best]), int(key[best]), int(start[best])))
        return pa.table([pa.array([r[i] for r in found], pa.int64()) for i in range(5)], names=names)

    return suffixes.groupBy("part").applyInArrow(build, ", ".join(f"{n} bigint" for n in names))


def _goes_on(leaves: list[np.ndarray], leaf: int) -> bool:
    """Whether another leaf goes on from the end of this one, so that ``grow`` has a node there already.

    The leaves are in the order of their bytes, in which those that go on follow at once.
    """
    if leaf + 1 == len(leaves):
        return False
    own, following = leaves[leaf], leaves[leaf + 1]
    return len(following) > len(own) and bool((following[: len(own)] == own).all())


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start, words, occurrences and text of every maximal repeat of 13 words or more.

    A repeat comes at two places or more, in one document or several. It is maximal if it can be made longer on
    neither side without losing a place. ``doc_id`` and ``start`` (a word's number, from 0) are its first
    place, by document; ``occurrences`` counts all of them.

    Suffixes are dealt to parts by prefixes of variable length. A first pass finds, in each part, the windows
    of 13 words that come twice, and whether the words before them differ; only there can a maximal repeat begin.
    Those suffixes, up to the end of what repeats in their document, go to their part once more, and each
    part grows its trees word by word. Inner nodes below depth 13 with different words before them are
    the repeats. Equal suffixes of a chunk of documents are one leaf, so that a passage of many documents
    does not fill its part.

    Words are known by 64-bit hashes. Null and empty texts have no words; a row that repeats a doc_id and text is
    left out; null doc_ids come last. doc_id must be a whole number. An empty table gives an empty one.
    """
    integer_ids(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = int(max(6, chars // (6 * GROUP_SUFFIXES)))
    frequent = _frequent_prefixes(docs, groups)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    chunks = keyed.withColumn("chunk", F.pmod("key", F.lit(int(max(1, -(-chars // CHUNK_CHARS))))))
    answers = staged(_answered(_asked(chunks, groups, frequent)), "windows")
    found = staged(_nodes(_suffixes(chunks, answers, groups, frequent)), "repeats")
    wanted = keyed.join(found.select("key").distinct(), "key", "left_semi")
    wanted = wanted.groupBy("key").agg(F.first(F.struct("doc_id", "text")).alias("row"))
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    part = F.slice(words, (F.col("start") + 1).cast("int"), F.col("words").cast("int"))
    whole = found.join(wanted, "key")
    return whole.select("row.doc_id", "start", "words", "occurrences", F.array_join(part, " ").alias("text"))
