"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periods

SCHEMA = "doc_id bigint, text string, runs string, n int, collapsed int"


def brute_runs(words):
    """(start, length, period) of all runs, by trying every period."""
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                run = words[i : i + length]
                if not any(run[d:] == run[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text, plant=False):
    words = (text or "").encode().split()
    if plant:
        words = planted(doc_id, words)
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = (None,) * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    return (
        doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def texts(seed, n):
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < pick.choice([5, 30, 80, 200, 400]):
            alphabet = "abcdefgh"[: pick.randint(1, 8)]
            block = pick.choices(alphabet, k=pick.choice([1, 2, 3, 5, 8, 9, 10, 13, 16, 20, 30]))
            words += (block * pick.randint(1, 7))[: pick.randint(1, 120)]
            if pick.random() < 0.3:
                words += block[:-1]
        out.append(pick.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_many_texts(seed):
    lists = [t.split() for t in texts(seed, 150)] + [[]]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    names = {}
    codes = np.array([names.setdefault(w, len(names)) for x in lists for w in x], np.int64)
    start, length, period = periods.runs_of(codes, starts)
    want = [(int(s) + a, b, c) for s, x in zip(starts, lists) for a, b, c in brute_runs(x)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want


def test_seeds_that_share_a_hash(monkeypatch):
    """Words of one hash: seeds are told apart by their words."""
    real = periods.window_hashes
    monkeypatch.setattr(periods, "window_hashes", lambda s, w, k: real(s, w % np.uint64(2) * np.uint64(0), k))
    words = (["a", "b", "c"] * 12 + list("defghijklmnopqrstuvwxyz") + ["x", "y"] * 20)
    names = {}
    codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    found = periods.runs_of(codes, np.array([0, len(codes)]))
    assert [tuple(int(v) for v in r) for r in zip(*found)] == brute_runs(words)


def test_stretches_that_recur_inside_a_period():
    """Every short stretch of the period occurs twice in it, so only long seeds tell the period."""
    one, two = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    shared = [f"s{i}" for i in range(40)]
    block = shared + one + shared + one + shared + two + shared + two
    words = ["begin", *block * 3, *block[:50], "end"]
    names = {}
    codes = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    found = periods.runs_of(codes, np.array([0, len(codes)]))
    assert [tuple(int(v) for v in r) for r in zip(*found)] == brute_runs(words)


def test_query_matches_brute_force(spark):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts(9, 120))]
    rows += [(500, None, None, None, None), (501, "", "", 0, 0), (502, " \n ", "", 0, 0), (None, "a b " * 40, "", 0, 0)]
    rows += [rows[3], rows[3], (None, None, "", 0, 0), (503, "w " * 30_000, "", 0, 0), (504, "Ä ä " * 13, "", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, periods.runs_digest(periods.with_planted_periods(docs)).collect()), key=str)
    brute = {r[:2]: digest(*r[:2], plant=True) for r in rows if r[0] != 503}
    want = sorted((brute[r[:2]] for r in rows if r[0] != 503), key=str)
    assert [r for r in got if r[0] != 503] == want
    (long,) = [r for r in got if r[0] == 503]
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000)
    plain = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert plain[503].collapsed == "w" and plain[500].collapsed == "" and plain[500].runs == []
    assert sorted(periods.collapsed_documents(docs).columns) == ["doc_id", "text"]


def test_empty_table_and_other_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periods.runs_digest(periods.with_planted_periods(empty)).count() == 0
    docs = spark.createDataFrame([("x", "a " * 30)], "doc_id string, text string")
    row = periods.periodic_runs(docs).first()
    assert row.doc_id == "x" and [tuple(r) for r in row.runs] == [(0, 30, 1)]


def test_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    plan = periods.runs_digest(periods.with_planted_periods(docs)).select(F.col("n_runs"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
