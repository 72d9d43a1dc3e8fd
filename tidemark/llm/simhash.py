"""Near-duplicates by SimHash: fingerprints that differ in a few bits, found in trees of bit distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.near import components
from tidemark.llm.shared import slices, staged
from tidemark.llm.tokens import spread
from tidemark.operators.skew import join_spread

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
#: Fingerprints of a shard on average, and of one tree at most; a larger shard has several trees.
SHARD, TREE = 256, 4096
#: Trees are sent to all tasks if they have no more nodes than this in all (12 bytes each), else shuffled.
MOST_BROADCAST = 500_000
#: Queries that walk down a tree at once.
AT_ONCE = 256
_BIT = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)


def _shingles(text: bytes | None) -> list[int]:
    """Hashes of the shingles of a text, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [digest(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.append(0, gaps[: len(gaps) - SHINGLE + 1] + 1).tolist()
    ends = np.append(gaps[SHINGLE - 1 :], len(joined)).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """SimHash of each text: a bit is 1 if more than half of its shingles' hashes have it."""
    hashes = [_shingles(text) for text in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(sizes)), sizes) * 256
    octets = flat.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(sizes), 8), np.uint8)
    for nth in range(8):
        times = np.bincount(doc + octets[:, nth], minlength=256 * len(sizes)).reshape(-1, 256)
        out[:, nth] = np.packbits(times @ _BIT * 2 > sizes[:, None], axis=1, bitorder="little")[:, 0]
    return out.reshape(-1).view(np.uint64)


def bk_tree(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in the order of their nodes, and of each node 65 times its parent plus its distance.

    Node 0 is the root. Values go down together, level by level: of those that stand at a node and have the
    same distance to it, the first becomes its child at that distance and the others go on to that child.
    Nodes of a level follow each other by parent and distance, so the second array ascends.
    """
    order, edges = [np.zeros(min(1, len(values)), np.int64)], [np.full(min(1, len(values)), -1, np.int64)]
    left, at, nodes = np.arange(1, len(values)), np.zeros(max(0, len(values) - 1), np.int64), 1
    while len(left):
        stands = values[np.concatenate(order)[at]]
        edge = at * (BITS + 1) + np.bitwise_count(values[left] ^ stands)
        taken, first, which = np.unique(edge, return_index=True, return_inverse=True)
        order.append(left[first])
        edges.append(taken)
        on = np.ones(len(left), bool)
        on[first] = False
        left, at = left[on], nodes + which[on]
        nodes += len(taken)
    return values[np.concatenate(order)], np.concatenate(edges)


def search(queries: np.ndarray, nodes: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places among the queries, nodes) of all that differ in at most RADIUS bits, a few queries at a time.

    By the triangle inequality only children whose distance to a node is within the radius of the query's own
    distance to it can hold such values; no other edge is followed.
    """
    for start in range(0, len(queries), AT_ONCE):
        query = np.arange(start, min(start + AT_ONCE, len(queries)))
        node = np.zeros(len(query), np.int64)
        found = []
        while len(node):
            distance = np.bitwise_count(queries[query] ^ nodes[node]).astype(np.int64)
            near = distance <= RADIUS
            found.append((query[near], node[near]))
            base = node * (BITS + 1)
            low = np.searchsorted(edges, base + np.maximum(distance - RADIUS, 0))
            high = np.searchsorted(edges, base + np.minimum(distance + RADIUS, BITS), side="right")
            query, node = np.repeat(query, high - low), spread(low, high - low)
        yield tuple(np.concatenate(part) for part in zip(*found, strict=True))


def connecting(queries: np.ndarray, nodes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of values that connect just those that the links of ``search`` connect, fewer than the values.

    Links of a block of queries are thinned before they are followed one by one: of each node to its
    first query, and of that query to the others that met the node.
    """
    values, place = np.unique(np.concatenate([queries, nodes]), return_inverse=True)
    of_query, of_node = place[: len(queries)], place[len(queries) :]
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for query, node in search(queries, nodes, edges):
        different, first = np.unique(node, return_index=True)
        leader = np.zeros(len(nodes), np.int64)
        leader[different] = query[first]
        others = np.unique(np.stack([query, leader[node]]), axis=1)
        one = np.concatenate([of_query[query[first]], of_query[others[0]]])
        two = np.concatenate([of_node[different], of_query[others[1]]])
        for a, b in zip(one.tolist(), two.tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[x] = y
                kept.append((a, b))
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return values[pairs[:, 0]], values[pairs[:, 1]]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row, the fingerprint as a long; 0 for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            found = pa.array(fingerprints(texts).view(np.int64))
            yield pa.record_batch([batch.column(0), found], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, fingerprint bigint")


def _masks(values: int) -> list[int]:
    """Bits that two values within the radius share in at least one of the masks, as signed longs.

    The 64 bits are cut into blocks, RADIUS of which may differ, so the others agree; a mask is a choice of
    those others. More blocks make longer masks, so that shards stay small, and more of them.
    """
    blocks = RADIUS + 1
    while 2 ** (BITS * (blocks - RADIUS) // blocks) * TREE < values and blocks < 2 * RADIUS:
        blocks += 1
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - RADIUS)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def trees(values: DataFrame) -> DataFrame:
    """(shard, part, nodes, edges): the trees of all shards of the different values ``fingerprint``.

    A shard holds the values that agree in the bits of a mask, and by chance some others; two values
    within the radius are in one shard at least. A shard of more than TREE values has several parts.
    """
    count = values.count()
    masks = _masks(count)
    shards = max(1, -(-count // SHARD))
    dealt = [
        F.pmod(F.xxhash64(F.lit(nth), F.col("fingerprint").bitwiseAND(F.lit(mask))), F.lit(shards)) * len(masks) + nth
        for nth, mask in enumerate(masks)
    ]
    members = values.select("fingerprint", F.explode(F.array(*dealt)).alias("shard"))
    large = members.groupBy("shard").agg(F.count("*").alias("size")).filter(F.col("size") > TREE)
    parts = F.ceil(F.coalesce("size", F.lit(1)) / TREE)
    part = F.pmod(F.xxhash64("fingerprint", F.lit("part")), parts)
    members = members.join(large, "shard", "left").select("shard", part.alias("part"), "fingerprint")

    def build(group: pa.Table) -> pa.Table:
        nodes, edges = bk_tree(np.sort(group["fingerprint"].to_numpy()).view(np.uint64))
        return pa.table(
            {
                "shard": group["shard"][:1],
                "part": group["part"][:1],
                "nodes": pa.array([nodes.astype("<u8").tobytes()], pa.binary()),
                "edges": pa.array([edges.astype("<i4").tobytes()], pa.binary()),
            }
        )

    return members.groupBy("shard", "part").applyInArrow(
        build, "shard bigint, part bigint, nodes binary, edges binary"
    )


def links(values: DataFrame) -> DataFrame:
    """(a, b) pairs of the different values ``fingerprint`` that connect just those within the radius of others.

    The trees of a shard go to the values of that shard, part by part: to all tasks, if all trees
    together have MOST_BROADCAST nodes at most, else by shuffle. Each task gives fewer pairs than it has values.
    """
    built = staged(trees(values), "trees")
    queries = built.select("shard", F.col("part").alias("own"), F.col("nodes").alias("queries"))
    nodes = built.agg(F.sum(F.length("nodes"))).first()[0] or 0
    theirs = F.broadcast(built) if nodes <= 8 * MOST_BROADCAST else built
    met = queries.join(theirs, "shard").filter("own <= part").select("queries", "nodes", "edges")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(3)), strict=True):
                queries, nodes, edges = (x.as_buffer() for x in row)
                a, b = connecting(
                    np.frombuffer(queries, "<u8"), np.frombuffer(nodes, "<u8"), np.frombuffer(edges, "<i4")
                )
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return met.mapInArrow(meet, "a bigint, b bigint")


def near_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Words are lower-cased for A-Z only and taken four at a time, repeats included; fewer are one
    shingle. Two documents are linked whose fingerprints differ in at most four bits; component_id is the
    least doc_id that links reach from a document, itself included.

    A null, empty or blank text has fingerprint zero and is linked like any other. Repeated rows are given
    each. A null doc_id counts as greater than any other: a component of such rows only has a null component_id.
    Other columns are not read, and an empty table gives an empty one.
    """
    signed = staged(fingerprinted(docs), "fingerprints")
    values = staged(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "values")
    reached = components(links(values))
    label = reached.select(F.col("row").alias("fingerprint"), "label")
    labelled = values.join(label, "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")
    )
    heads = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    known = labelled.select("fingerprint", "label").join(heads, "label").select("fingerprint", "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return join_spread(signed, staged(known, "components"), ["fingerprint"]).select("doc_id", digits, "component_id")


def without_near_fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their component; rows without doc_id are left out."""
    stay = near_fingerprints(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay.select(F.col("doc_id").alias("_stays")), F.col("doc_id") == F.col("_stays"), "left_semi")
