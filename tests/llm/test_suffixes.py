"""Maximal repeats against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import repeats, suffixes

SCHEMA = "doc_id bigint, text string, key string, words string, part string"


def brute(texts):
    """{words: (occurrences, first doc, first start)} of maximal repeats of 13 words or more."""
    places = defaultdict(list)
    for d, words in enumerate(texts):
        for i in range(len(words)):
            for j in range(i + 13, len(words) + 1):
                places[tuple(words[i:j])].append((d, i))
    out = {}
    for w, own in places.items():
        if len(own) < 2:
            continue
        before = {texts[d][i - 1] if i else (d, "begin") for d, i in own}
        after = {texts[d][i + len(w)] if i + len(w) < len(texts[d]) else (d, "end") for d, i in own}
        if len(before) > 1 and len(after) > 1:
            out[" ".join(w)] = (len(own), *min(own))
    return out


def planted(seed, n=14):
    pick = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(pick.randint(13, 25))] for k in range(4)]
    passages.append([pick.choice("ab") for _ in range(20)])
    texts = []
    for d in range(n):
        words = []
        for _ in range(pick.randint(0, 4)):
            part = pick.choice(passages)
            words += [f"d{d}x{pick.randint(0, 9)}" for _ in range(pick.randint(0, 3))]
            words += part[pick.choice([0, 0, 1]) : pick.choice([len(part), len(part), len(part) - 1])]
        texts.append(words)
    return [*texts, texts[0], texts[1], ["a"] * 40, [], ["x"] * 12]


@pytest.mark.parametrize("seed", range(3))
def test_maximal_repeats(spark, seed, monkeypatch):
    texts = planted(seed)
    monkeypatch.setattr(suffixes, "CHUNK_CHARS", 700)
    rows = [(i, " ".join(words), "clash", "clash", "clash") for i, words in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[2], (999, None, "", "", "")], SCHEMA).repartition(3)
    got = suffixes.maximal_repeats(df).collect()
    assert {r.text: (r.occurrences, r.doc_id, r.start) for r in got} == brute(texts)
    assert len(got) == len({r.text for r in got}) and all(r.words == len(r.text.split()) for r in got)


def test_equal_and_null_ids(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    rows = [(7, f"a {passage} b"), (7, f"c {passage}"), (None, f"{passage} d e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    (row,) = suffixes.maximal_repeats(df).collect()
    assert (row.doc_id, row.start, row.words, row.occurrences, row.text) == (7, 1, 15, 3, passage)


def test_tree_parts_where_words_do():
    sequences = [np.array(s, np.uint64) for s in ([1, 2, 3], [1, 2, 4], [1, 2], [5], [5, 6, 7, 8], [5, 6, 7, 9])]
    nodes = {(depth, tuple(sorted(leaves.tolist()))) for depth, leaves in suffixes.grow(sequences)}
    assert nodes == {(0, (0, 1, 2, 3, 4, 5)), (2, (0, 1, 2)), (1, (3, 4, 5)), (3, (4, 5))}


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffixes.maximal_repeats(empty).count() == 0
    named = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    for operator in (suffixes.maximal_repeats, repeats.without_repeats):
        with pytest.raises(ValueError, match="doc_id is string"):
            operator(named)


def test_heavy_buckets_are_split(spark, monkeypatch):
    """Rows without an id share a bucket, and rows of one id; both are dealt to several tasks."""
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"x {passage}")] + [(None, f"n{i} {passage} z") for i in range(150)] + [(5, f"{passage} y")] * 150
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = repeats.repeats_digest(df).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    monkeypatch.setattr(repeats, "BUCKET_CHARS", 1000)
    split, marks = repeats._split(
        df.selectExpr("doc_id", "text", "COALESCE(doc_id, 7L) AS bucket"), spark.createDataFrame([(7,), (1,)], "bucket bigint")
    )
    assert split.groupBy("bucket", "part").count().filter("bucket = 7").count() > 5
    assert marks.count() > 6 and split.count() == len(rows)
    got = repeats.repeats_digest(df).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {(r.doc_id, r.n_removed) for r in got} == {(1, 0), (None, 30), (5, 30)}
