"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

A fingerprint has 64 bits, one for each bit that is set in over half the hashes of a text's 3-word
shingles. Two fingerprints link at ``RADIUS`` or fewer differing bits; components of links are the
groups of near-duplicates.

Search. The bits are cut into two blocks; of two linked fingerprints, one block differs in at most
``RADIUS // 2`` bits. A vantage-point tree over each block's Hamming distance splits fingerprints at
a vantage point into those within its median distance and those beyond. By the triangle inequality
a partner on the other side lies within the block's radius of that boundary, so only such
fingerprints are also sent there, as guests. Top trees are grown from a bounded sample, and their
leaves are the shards of one shuffle; in a shard the splitting goes on until a handful of
fingerprints are left, which are compared bit by bit. Every link is found; a shard returns a
spanning forest of its links, not all pairs.

Components come from alternating large-star and small-star steps over the forests' edges, with a
checkpoint after each. Only distinct fingerprints are searched, however many documents share one.

Defined cases: a text without words (null or empty too) has fingerprint zero, which links like any
other; a text of one or two words has one shingle; a very long text counts whole; equal rows share a component; null ids stay and
count as larger than any id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import reliable_checkpoint

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Vantage points that are tried for a split.
VANTAGE_POINTS = 8
#: The blocks of bits that have a tree each.
BLOCKS = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
#: Fingerprints of the sample for each shard, shards of a tree (at most: trees and sample are held by the driver
#: and sent to all tasks, 10 MB at that size), fingerprints of a shard before there are more shards, and of a leaf.
SAMPLE_OF_SHARD, MOST_SHARDS, SHARD_SIZE, LEAF_SIZE = 16, 1 << 16, 4096, 256


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined, k = b" ".join(words), min(SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(bits), 255):
        counts += bits[lo : lo + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint's 64 bits as a signed integer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"") for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        scan, "doc_id bigint, bits bigint"
    )


class Tree:
    """A vantage-point tree over one block of bits: node k has the children 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, depth: int):
        self.mask, self.depth, n = mask, depth, (1 << depth) - 1
        self.points, self.medians = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        held = {0: sample}
        for node in range(n):
            own = held.pop(node)
            if len(own):
                self.points[node] = point = own[len(own) // 2]
                d = np.bitwise_count((own ^ point) & mask)
                self.medians[node] = median = int(np.median(d))
                held |= {2 * node + 1: own[d <= median], 2 * node + 2: own[d > median]}
            else:
                held |= {2 * node + 1: own, 2 * node + 2: own}

    def shards(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Leaves with the positions of the fingerprints at home there and of their guests."""
        todo = [(0, np.arange(len(prints)), np.zeros(0, np.int64))]
        while todo:
            node, home, guest = todo.pop()
            if not len(home) + len(guest):
                continue
            if node >= len(self.points):
                yield node - len(self.points), home, guest
                continue
            todo += [(2 * node + 1 + k, *sides) for k, sides in enumerate(split(prints, home, guest, self.points[node], self.medians[node], self.mask))]


def split(prints, home, guest, point, median, mask, reach=RADIUS // len(BLOCKS)) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The two sides of a vantage point; who is near the boundary is a guest on the other side.

    Outer ones are guests inside, which is enough to see each pair once; guests go to both sides.
    """
    dh, dg = (np.bitwise_count((prints[x] ^ point) & mask).astype(np.int64) for x in (home, guest))
    inner, outer = home[dh <= median], home[dh > median]
    near = home[(dh > median) & (dh <= median + reach)]
    return (inner, np.concatenate([near, guest[dg <= median + reach]])), (outer, guest[dg > median - reach])


class Forest:
    """Union-find over positions, with links given as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, lo, hi = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.root, hi, lo)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def cut(prints: np.ndarray, own: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance that some of a shard's fingerprints are within and others beyond, or None."""
    for k in range(VANTAGE_POINTS):
        point = prints[own[len(own) * (2 * k + 1) // (2 * VANTAGE_POINTS)]]
        d = np.bitwise_count((prints[own] ^ point) & mask)
        for at in (int(np.median(d)), int(d.min())):
            if (d > at).any() and (d <= at).any():
                return point, at
    return None


def shard_links(prints: np.ndarray, home: np.ndarray, guest: np.ndarray, mask: np.uint64) -> Forest:
    """A forest of all links between fingerprints at home in a shard and those at home or guests.

    Where a block's distances tell a shard's fingerprints not apart, those over all bits do.
    """
    forest, todo, every = Forest(len(prints)), [(home, guest)], np.uint64(0xFFFFFFFFFFFFFFFF)
    while todo:
        own, other = todo.pop()
        if len(own) > LEAF_SIZE:
            for bits, reach in ((mask, RADIUS // len(BLOCKS)), (every, RADIUS)):
                if found := cut(prints, own, bits):
                    todo += split(prints, own, other, *found, bits, reach)
                    break
            else:
                raise AssertionError("distinct fingerprints differ from one of them")
            continue
        beside = np.concatenate([own, other])
        a, b = np.nonzero(np.bitwise_count(prints[own][:, None] ^ prints[beside][None, :]) <= RADIUS)
        forest.link(own[a], beside[b])
    return forest


def link_forests(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``bits``) that connect what is linked."""
    n = prints.count()
    depth = (min(MOST_SHARDS, n // SHARD_SIZE) or 1).bit_length() - (n < SHARD_SIZE)
    sample = prints.orderBy(F.xxhash64("bits"), "bits").limit(SAMPLE_OF_SHARD << depth).toPandas()["bits"].to_numpy(np.int64).view(np.uint64)
    trees = [Tree(sample, mask, depth) for mask in BLOCKS]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(trees):
                for leaf, home, guest in tree.shards(own):
                    at = np.concatenate([home, guest])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), k << 24 | leaf, np.int32)), pa.array(own[at].view(np.int64)), pa.array(np.arange(len(at)) < len(home))],
                        names=["shard", "bits", "home"],
                    )

    def search(table: pa.Table) -> pa.Table:
        mask = BLOCKS[table.column("shard")[0].as_py() >> 24]
        own, home = table.column("bits").to_numpy().view(np.uint64), table.column("home").to_numpy()
        root = shard_links(own, np.flatnonzero(home), np.flatnonzero(~home), mask).root
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([pa.array(own[at].view(np.int64)), pa.array(own[root[at]].view(np.int64))], names=["u", "v"])

    return prints.mapInArrow(route, "shard int, bits bigint, home boolean").groupBy("shard").applyInArrow(search, "u bigint, v bigint").where("u <> v")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (u, v); the root is the component's least node."""
    state, before = reliable_checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v"), F.col("v")).distinct())
        before = now
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
        large = both.join(least, both.u == least.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, large.u == least.c).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        state = reliable_checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, bits and component_id, the least id of the documents reachable over links."""
    rows = reliable_checkpoint(fingerprints(docs))
    prints = reliable_checkpoint(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = connected(link_forests(prints.select("bits")))
    rooted = prints.join(roots, prints.bits == roots.node, "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = reliable_checkpoint(rooted.join(groups, "root").select(F.col("bits").alias("b"), "component_id"))
    return rows.join(named, rows.bits == named.b).select("doc_id", "bits", "component_id")


def near_duplicates_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
