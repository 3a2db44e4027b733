"""SimHash near-dedup at a stated similarity: groups of texts whose word shingles have a Jaccard
similarity of at least ``SIMILARITY``.

The fingerprint trees of ``simhash`` run over five-word shingles first; their links join most copies.
At this similarity two fingerprints differ in about ten bits, though, where a tree can prune nothing,
so bands complete the search: texts that agree in one of ``BANDS`` bands of ``ROWS`` minimum hashes
are candidates too. Two texts at similarity s meet in none with probability
(1 - s ** ROWS) ** BANDS, which is 5e-8 at 0.8 and less above. Every link is confirmed on the whole
sets of shingles, so none is false.

A bucket's texts are first compared with its hub only, the one that meets most others. Buckets that
still have several groups are put together by hub, and shingles that occur in no other group are
counted: if c of a text's n shingles occur elsewhere, a partner with m needs ``9 c >= 4 (n + m)``, for
both sides. That bound rules out most pairs of a large group's members without looking at them. All pairs
that it leaves are compared, in blocks of about ``BLOCK_SHINGLES``, and only links leave a task; so no
candidate is left out. Texts of one hub that share nearly all shingles
with others and yet are similar to none still cost the square of their number in comparisons.

Texts are compared by their words in ASCII lower case and are one node where these are equal. A
node's key has 64 bits, so n different texts give about n * n / 2 ** 65 false matches.

Defined cases: a text of fewer than ``SHINGLE`` words has one shingle; texts without words (null or
empty too) are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import reliable_checkpoint, slices
from quaymark.llm.simhash import connected, link_forests, majority

SHINGLE, BANDS, ROWS, SEED = 5, 32, 4, 42
#: The least similarity, as a fraction.
SIMILARITY = (4, 5)
#: Shingles that are hashed at a time, at most, and those of a block of texts to compare, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = np.random.default_rng(SEED + 1).integers(0, 2**63, BANDS * ROWS, np.uint64)


def shingles(words: bytes) -> set[bytes]:
    """The distinct shingles of words joined by single spaces."""
    found = words.split()
    return {b" ".join(found[k : k + SHINGLE]) for k in range(max(1, len(found) - SHINGLE + 1))}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def hashes(own: set[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own))


def bands(hashed: np.ndarray) -> np.ndarray:
    """A hash for each band of the shingles' minimum hashes, as signed integers."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashed), BLOCK):
        np.minimum(least, (hashed[lo : lo + BLOCK, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def joined_words(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def node(words: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(words, SEED) - 2**63


def nodes(docs: DataFrame, identity: Column, signed: bool) -> DataFrame:
    """doc_id, identity and key of each row, with the number of shingles, fingerprint and bands or, unsigned, the words."""
    extra = "n bigint, bits bigint, bands array<bigint>" if signed else "words binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            words = [joined_words(t.as_py()) for t in batch.column(2)]
            keys = pa.array([node(w) for w in words], pa.int64())
            if signed:
                # One text's shingles at a time: those of a batch take many times its texts.
                n, bits, found = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64), np.zeros((len(words), BANDS), np.int64)
                for k, w in enumerate(words):
                    own = hashes(shingles(w))
                    n[k], bits[k], found[k] = len(own), majority(own) if w else 0, bands(own)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * BANDS), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, pa.array(n), pa.array(bits.view(np.int64)), lists], names=["doc_id", "identity", "key", "n", "bits", "bands"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, pa.array(words, pa.binary())], names=["doc_id", "identity", "key", "words"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), identity.alias("identity"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(scan, f"doc_id bigint, identity bigint, key bigint, {extra}")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingles are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, other = [], None, set()
            for a, b in ((x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)):
                if b != last:
                    last, other = b, shingles(b)
                keep.append(similar(shingles(a), other))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    of = lambda name: texts.select(F.col("key").alias(name), F.col("words").alias(f"{name}_words"))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_words", "v_words").mapInArrow(compare, "u bigint, v bigint")


def length_fits(a: str, b: str) -> Column:
    """Sets whose sizes differ too much cannot be similar enough."""
    return SIMILARITY[1] * F.least(a, b) >= SIMILARITY[0] * F.greatest(a, b)


def ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")


def tree_pairs(unique: DataFrame) -> DataFrame:
    """Pairs (u, v) of keys with one fingerprint, or joined by the forests of the vantage-point trees."""
    first = unique.groupBy("bits").agg(F.min(F.struct("key", "n")).alias("one"))
    twins = unique.join(first, "bits").where("key <> one.key").where(length_fits("n", "one.n")).select(*ordered("key", "one.key"))
    of = lambda name: first.select(F.col("bits").alias(name), F.col("one").alias(f"{name}_one"))
    far = link_forests(first.select("bits")).join(of("u"), "u").join(of("v"), "v").where(length_fits("u_one.n", "v_one.n"))
    return twins.union(far.select(*ordered("u_one.key", "v_one.key")))


def hubs(members: DataFrame, rank: Column) -> DataFrame:
    """The member of highest rank of each bucket."""
    return members.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), "key", "n", "group")).alias("hub"))


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of members in other groups than their hub, and the hub."""
    return members.where("group <> hub.group").where(length_fits("n", "hub.n")).select(*ordered("key", "hub.key")).distinct()


def regrouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their groups' roots; only of buckets that still have several groups."""
    named = members.join(roots, F.col("group") == F.col("node"), "left")
    return mixed(named.withColumn("group", F.coalesce("root", "group")).drop("node", "root"), "bucket")


def mixed(members: DataFrame, by: str) -> DataFrame:
    """The members of buckets with several groups."""
    several = members.groupBy(by).agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select(by)
    return members.join(several, by, "left_semi")


def shingle_lists(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key and the hashes of the distinct shingles of some texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            lists = [hashes(shingles(w.as_py())).view(np.int64) for w in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["key", "shingles"])

    return reliable_checkpoint(texts.join(keys, "key", "left_semi").mapInArrow(scan, "key bigint, shingles array<bigint>"))


def with_shared(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Members with ``shared``, the number of their shingles that a text of another group has too; who has none is dropped."""
    rows = lists.join(members.select("key", "group").distinct(), "key").select("key", "group", F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("shingle")
    return members.join(rows.join(common, "shingle").groupBy("key").agg(F.count("*").alias("shared")), "key")


def possible(members: DataFrame) -> DataFrame:
    """Members that have room for a partner: of two linked texts the shorter one has room for its own length."""
    p, q = SIMILARITY
    own = F.expr(f"{p + q} * shared >= {2 * p} * n")
    least = members.where(own).groupBy("pivot").agg(F.min("n").alias("least"))
    fits = own | F.expr(f"{p + q} * shared - {p} * n >= {p} * least")
    return reliable_checkpoint(mixed(members.join(least, "pivot").where(fits).drop("least"), "pivot"))


def remaining_links(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Links (u, v) between the groups of one pivot's texts: a forest of them in each pair of blocks."""
    p, q = SIMILARITY
    sizes = members.groupBy("pivot").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    home = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = members.join(sizes, "pivot").select("pivot", "key", "n", "group", "shared", "blocks", home.alias("home")).join(lists, "key")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.select("pivot", F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), "home", "n", "group", "shared", "shingles")

    def search(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        home, n, group, shared = (table.column(c).to_numpy() for c in ("home", "n", "group", "shared"))
        shingles, sets, links = table.column("shingles"), {}, []
        forest = dict(zip(group.tolist(), group.tolist(), strict=True))

        def root(g: int) -> int:
            while forest[g] != g:
                forest[g] = g = forest[forest[g]]
            return g

        def held(k: int) -> set[int]:
            if k not in sets:
                sets[k] = set(shingles[k].values.to_pylist())
            return sets[k]

        beside = np.flatnonzero(home == hi)
        for a in np.flatnonzero(home == lo).tolist():
            both, sums = np.minimum(shared[beside], shared[a]), n[beside] + n[a]
            found = beside[((p + q) * both >= p * sums) & (q * np.minimum(n[beside], n[a]) >= p * np.maximum(n[beside], n[a])) & (group[beside] != group[a])]
            for b in (found if lo < hi else found[found > a]).tolist():
                x, y = root(int(group[a])), root(int(group[b]))
                if x != y and (p + q) * len(held(a) & held(b)) >= p * int(n[a] + n[b]):
                    forest[x] = y
                    links.append((int(group[a]), int(group[b])))
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["u", "v"])

    return dealt.groupBy("pivot", "lo", "hi").applyInArrow(search, "u bigint, v bigint").distinct()


def near_copies(docs: DataFrame, identity: Column) -> DataFrame:
    """doc_id, identity (a bigint) and root of each row; rows with one root are near copies, over any number of links."""
    rows = reliable_checkpoint(nodes(docs, identity, True))  # the shingles of all texts are made once
    unique = reliable_checkpoint(rows.dropDuplicates(["key"]).select("key", "n", "bits", "bands"))
    held = unique.select("key", "n", F.explode("bands").alias("bucket"))
    members = held.join(held.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket")
    meets = members.groupBy("key").agg(F.sum("size").alias("meets"))
    members = members.drop("size").join(meets, "key").withColumn("group", F.col("key"))
    members = reliable_checkpoint(members.join(hubs(members, F.col("meets")), "bucket").drop("meets"))
    pairs = reliable_checkpoint(star_pairs(members).union(tree_pairs(unique)).distinct())
    wanted = members.select("key").union(pairs.select("u")).union(pairs.select("v")).distinct()
    texts = reliable_checkpoint(nodes(docs, identity, False).select("key", "words").join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    roots = reliable_checkpoint(connected(confirmed(pairs, texts)))
    # What the first hubs left over, by hub: each text once for each.
    left = reliable_checkpoint(regrouped(members, roots).select(F.col("hub.key").alias("pivot"), "key", "n", "group").distinct())
    lists = shingle_lists(texts, left.select("key").distinct())
    merged = connected(remaining_links(possible(with_shared(left, lists)), lists)).select(F.col("node").alias("group"), F.col("root").alias("last"))
    named = roots.select(F.col("node").alias("key"), F.col("root").alias("group"))
    found = rows.select("doc_id", "identity", "key").join(named, "key", "left").withColumn("group", F.coalesce("group", "key")).join(merged, "group", "left")
    return found.select("doc_id", "identity", F.coalesce("last", "group").alias("root"))
