"""Exact dedup against history: a minimal perfect hash over the digests already seen.

Two texts are equal when they are identical after lower-casing A-Z only, so a text stands for its
SHA-256 in that form. ``build_index`` takes the distinct digests of history, deals them by their
leading bytes into shards of about ``SHARD`` digests and makes a minimal perfect hash of each shard
(levels of bit arrays: a digest that falls alone on a bit of a level has found its place, the others
go to the next level; its slot is the number of bits before its own). A slot holds the whole digest
of 32 bytes, how many rows of history had it, and the locator of the row that wins: its doc_id and row number.
``look_up`` brings new digests, summed to one row each, to their shard, and compares all 32 bytes with those of the slot:
members are repeats of history, what is no member is a group of its own. The index is a table with a row
for each shard, so it can be stored and extended by the next batch (``merged``).

Of equal texts the row with the largest doc_id stays. Groups of at least a ``HEAVY``-th of all rows are
at most ``HEAVY`` in number, so their answers are broadcast; those of the others are joined by digest.

Defined cases: a null text counts as empty; a null doc_id is less than any other, and of rows that share
the largest one the last in reading order stays, so a group always keeps one row; empty tables, of history too, give no
rows or no members; very long texts are digested whole, in slices of few bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import bare_texts, reliable_checkpoint, slices

#: Digests in a shard, on average.
SHARD = 20_000
#: Bits of a level for each digest that is still without a place.
SPARSE = 2
#: Levels before what is left is listed; half a shard's digests or more find a place on each.
LEVELS = 60
#: At most as many groups are answered by broadcast, of about 70 bytes each.
HEAVY = 100_000
INDEX = "shard int, sizes array<bigint>, bits binary, digests binary, doc_ids array<bigint>, rows array<bigint>, counts array<bigint>"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row number and digest of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                # bytes.lower() changes A-Z only.
                found = [hashlib.sha256(t.lower()).digest() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "digest"])

    return bare_texts(docs).mapInArrow(scan, "doc_id bigint, digest binary").withColumn("row", F.monotonically_increasing_id())


def distinct(rows: DataFrame) -> DataFrame:
    """A row for each digest: how many rows have it and which of them wins."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "row")).alias("winner"))


def places(words: np.ndarray, level: int, n: int) -> np.ndarray:
    """The bit of ``n`` that each digest (a row of four words) has on a level."""
    mixed = np.full(len(words), np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1), np.uint64)
    for k in range(words.shape[1]):
        mixed = (mixed ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(n)).astype(np.int64)


def as_words(digest: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digest).view("<u8").reshape(-1, 4)


def perfect_hash(digest: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits together, and the slot of each of some distinct digests (n x 32 bytes)."""
    words, left = as_words(digest), np.arange(len(digest))
    sizes, levels, at = [], [], np.full(len(digest), -1, np.int64)
    with np.errstate(over="ignore"):
        while len(left) and len(sizes) < LEVELS:
            n = SPARSE * len(left) + 8
            place = places(words[left], len(sizes), n)
            alone = np.bincount(place, minlength=n) == 1
            settled = alone[place]
            at[left[settled]] = place[settled] + sum(sizes)
            left = left[~settled]
            sizes.append(n)
            levels.append(alone)
    bits = np.concatenate([*levels, np.zeros(0, bool)])
    rank = np.cumsum(bits) - bits
    slot = np.where(at >= 0, rank[at] if len(rank) else 0, -1)
    slot[left] = int(bits.sum()) + np.arange(len(left))
    return sizes, bits, slot


def slots_of(digest: np.ndarray, sizes: list[int], bits: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The slot whose 32 bytes (``held``) are those of each digest; -1 for what is no member."""
    found, left, base = np.full(len(digest), -1, np.int64), np.arange(len(digest)), 0
    if not len(held) or not len(digest):
        return found
    words, rank = as_words(digest), np.cumsum(bits) - bits
    with np.errstate(over="ignore"):
        for level, n in enumerate(sizes):
            place = places(words[left], level, n) + base
            here = bits[place]
            found[left[here]] = rank[place[here]]
            left, base = left[~here], base + n
    tail = {held[k].tobytes(): k for k in range(int(bits.sum()), len(held))}
    for k in left if tail else ():
        found[k] = tail.get(digest[k].tobytes(), -1)
    same = (found >= 0) & (held[found] == digest).all(axis=1)
    return np.where(same, found, -1)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Digests of a column as rows of 32 bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def shard_of(shards: int):
    return (F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("bigint") % shards).cast("int")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index over distinct digests (``distinct``): a row for each of ``shards`` shards that has any."""

    def build(table: pa.Table) -> pa.Table:
        digest = bytes_of(table.column("digest"))
        sizes, bits, slot = perfect_hash(digest)
        order = pa.array(np.argsort(slot))
        winner = table.column("winner").combine_chunks()
        row = {
            "shard": table.column("shard")[0].as_py(), "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": digest[order.to_numpy()].tobytes(),
            "doc_ids": winner.field("doc_id").take(order).to_pylist(), "rows": winner.field("row").take(order).to_pylist(), "counts": table.column("size").combine_chunks().take(order).to_pylist(),
        }
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds, strict=True)})

    return history.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(build, INDEX)


def look_up(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The batch's distinct digests with ``member``, and for members the count and winner that history holds."""

    def find(own: pa.Table, held: pa.Table) -> pa.Table:
        n = own.num_rows
        at = np.full(n, -1, np.int64)
        if n and held.num_rows:
            row = held.slice(0, 1).to_pylist()[0]
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
            at = slots_of(bytes_of(own.column("digest")), row["sizes"], bits, np.frombuffer(row["digests"], np.uint8).reshape(-1, 32))
        take = lambda name: pa.array([row[name][k] if k >= 0 else None for k in at.tolist()] if (at >= 0).any() else [None] * n, pa.int64())
        told = {name: own.column(name) for name in ("digest", "size", "doc_id", "row")}
        return pa.table(told | {"member": pa.array(at >= 0), "past_size": take("counts"), "past_doc_id": take("doc_ids"), "past_row": take("rows")})

    flat = batch.select(shard_of(shards).alias("shard"), "digest", "size", "winner.doc_id", "winner.row")
    schema = "digest binary, size bigint, doc_id bigint, row bigint, member boolean, past_size bigint, past_doc_id bigint, past_row bigint"
    found = flat.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(find, schema)
    past = F.when(F.col("member"), F.struct(F.col("past_doc_id").alias("doc_id"), F.col("past_row").alias("row")))
    return found.select("digest", "size", F.struct("doc_id", "row").alias("winner"), "member", "past_size", past.alias("past_winner"))


def entries(index: DataFrame) -> DataFrame:
    """What the slots of an index hold, a row each."""
    slot = F.explode(F.arrays_zip("doc_ids", "rows", "counts", F.sequence(F.lit(0), F.size("rows") - 1).alias("at"))).alias("s")
    return index.where(F.size("rows") > 0).select("digests", slot).select(
        F.expr("substring(digests, 32 * s.at + 1, 32)").alias("digest"), F.col("s.counts").alias("size"), F.struct(F.col("s.doc_ids").alias("doc_id"), F.col("s.rows").alias("row")).alias("winner")
    )


def merged(index: DataFrame, found: DataFrame) -> DataFrame:
    """Digests of history and of a batch that was looked up, with the sizes and winners of both together."""
    news = found.where("NOT member").select("digest", "size", "winner")
    repeats = found.where("member").select("digest", (F.col("size") + F.col("past_size")).alias("size"), F.greatest("winner", "past_winner").alias("winner"))
    silent = entries(index).join(repeats.select("digest"), "digest", "left_anti")
    return news.unionByName(repeats).unionByName(silent)


def answer(rows: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """Each row with its group: large groups by broadcast, as there are ``HEAVY`` of them at most, the others by digest."""
    large = F.col("size") >= max(2, -(-n_rows // HEAVY))
    told = groups.withColumnRenamed("digest", "d")
    heavy, light = F.broadcast(told.where(large)), told.where(~large)
    by_heavy = rows.join(heavy, F.col("digest") == F.col("d"))
    rest = rows.join(heavy.select("d"), F.col("digest") == F.col("d"), "left_anti")
    return by_heavy.unionByName(rest.join(light, F.col("digest") == F.col("d")))


def dedup_digest(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Every document with its group: the older half of the ids is history, the others are looked up in it."""
    rows = reliable_checkpoint(digests(docs))
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    older = F.col("doc_id").isNull() | (F.col("doc_id") <= ((span.least or 0) + (span.most or 0)) // 2)
    shards = max(1, span.n // (2 * shard))
    index = reliable_checkpoint(build_index(distinct(rows.where(older)), shards))
    groups = reliable_checkpoint(merged(index, look_up(distinct(rows.where(~older)), index, shards)))
    return answer(rows, groups, span.n).select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("winner.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


DEDUP_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d"""
