"""SimHash fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash

SCHEMA = "doc_id bigint, text string, shard string, part int, label int, fingerprint int, size int"
ODD = ("clash", 1, 2, 3, 4)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def brute_components(fingerprints):
    """Least id of each component, by comparing all pairs."""
    label = {i: i for i in fingerprints}
    changed = True
    while changed:
        changed = False
        for i, x in fingerprints.items():
            for j, y in fingerprints.items():
                if label[j] < label[i] and (x ^ y).bit_count() <= 4:
                    label[i], changed = label[j], True
    return label


def texts(seed=1):
    pick = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    out = [" ".join(pick.choices(words, k=pick.randint(1, 60))) for _ in range(60)]
    for i in range(12):
        base = pick.choices(words, k=300)
        for _ in range(6):
            edited = list(base)
            edited[pick.randrange(300)] = "edit"
            out.append(" ".join(edited))
    return [*out, out[0].upper(), out[1], "Ä ä é ß", "Ä", None, "", " \n\t", "a", "A", " ".join(pick.choices(words, k=40_000))]


def test_tree_search_finds_all():
    random_ = np.random.default_rng(3)
    base = random_.integers(0, 1 << 63, 30, np.uint64)
    values = [base]
    for _ in range(8):
        flips = np.uint64(1) << random_.integers(0, 64, 30).astype(np.uint64)
        values.append(values[-1] ^ flips)
    values = np.unique(np.concatenate(values))
    nodes, edges = simhash.bk_tree(values)
    assert sorted(nodes.tolist()) == values.tolist() and (np.diff(edges) > 0).all()
    for node in range(1, len(nodes)):
        parent, distance = divmod(int(edges[node]), 65)
        assert parent < node and (int(nodes[parent]) ^ int(nodes[node])).bit_count() == distance
    found = {(q, n) for qs, ns in simhash.search(values, nodes, edges) for q, n in zip(qs.tolist(), ns.tolist())}
    distance = np.bitwise_count(values[:, None] ^ nodes[None, :])
    assert found == set(zip(*(x.tolist() for x in np.nonzero(distance <= 4))))


def test_few_pairs_connect_a_dense_group():
    """Thousands of values near each other give fewer pairs than values, and stay connected."""
    low = np.unique(np.array([sum(1 << b for b in bits) for bits in simhash.combinations(range(24), 4)], np.uint64))
    values = low[:3000]
    a, b = simhash.connecting(values, *simhash.bk_tree(values))
    assert len(a) < len(values)
    label = {v: v for v in values.tolist()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[root(x)] = root(y)
    near = {int(x): [int(y) for y in values[:200] if (int(x) ^ int(y)).bit_count() <= 4] for x in values[:200]}
    assert all(root(x) == root(y) for x, ys in near.items() for y in ys)


@pytest.mark.parametrize("count", [10, 10**8, 10**12])
def test_masks_cover_the_radius(count):
    masks = [m % (1 << 64) for m in simhash._masks(count)]
    pick = random.Random(4)
    for _ in range(500):
        flipped = sum(1 << bit for bit in pick.sample(range(64), 4))
        assert any(m & flipped == 0 for m in masks)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i + 5, t, *ODD) for i, t in enumerate(texts())]
    rows += [rows[0], rows[0], (None, rows[3][1], *ODD), (None, "only here without an id at all", *ODD)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def check(rows, got):
    prints = {i: brute_fingerprint(text) for i, text, *_ in rows if i is not None}
    label = brute_components(prints)
    want = []
    for i, text, *_ in rows:
        x = brute_fingerprint(text)
        linked = [label[j] for j, y in prints.items() if (x ^ y).bit_count() <= 4]
        want.append((i, f"{x:016x}", min(linked) if linked else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_components_match_brute_force(docs):
    check(docs[0], simhash.near_fingerprints(docs[1]))


def test_shards_of_many_parts(docs, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 7)
    monkeypatch.setattr(simhash, "MOST_BROADCAST", 0)
    check(docs[0], simhash.near_fingerprints(docs[1]))


def test_fingerprint_is_that_of_spark(spark):
    text = "One two THREE four"
    (got,) = simhash.fingerprints([text.encode()]).view(np.int64).tolist()
    (hashed,) = spark.range(1).select(F.xxhash64(F.lit(text.lower()))).first()
    assert got == hashed


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_fingerprints(empty).count() == 0


def test_one_of_each_component_stays(docs):
    rows, df = docs
    stay = simhash.without_near_fingerprints(df)
    assert stay.columns == df.columns
    ids = [r.doc_id for r in stay.select("doc_id").collect()]
    assert 5 in ids and len(set(ids)) < len(rows)
