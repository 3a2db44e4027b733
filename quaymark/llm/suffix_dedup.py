"""Removal of repeated byte strings by a distributed difference-cover suffix comparison.

A byte goes when some string of ``LENGTH`` bytes that covers it also starts anywhere else, in the
same document or in another. Suffixes are those of single documents, so no match crosses documents.

1. Sampled triples. Sampled are the offsets whose residue modulo ``PERIOD`` is in ``COVER``, a
   perfect difference cover: for any two offsets one shift below ``PERIOD`` puts both into the
   sample. A name stands for the bytes that follow an offset; it is made of the names of three
   shorter stretches, which are triples in turn (8, 24, 68, 200, 332 bytes). Names are 64-bit
   fingerprints, not ranks, for equality of prefixes is all that is asked for.
2. Sorting. The sampled names of 68 bytes are dealt to buckets by their leading bits and sorted
   there; a name next to an equal one is repeated. Two equal strings of 200 bytes hold such a pair
   of sampled suffixes, so a stretch without a repeated sample is done with.
3. Recursion on names. Of the repeated samples, the names of 332 bytes are sorted in the same way.
   Where one is repeated, each suffix up to the next sample of its residue repeats for 200 bytes.
4. Merging. Suffixes lean on the repeated samples within the next ``PERIOD`` bytes. A sample on
   which any suffix leans that is still unsettled, in whatever chunk, calls in all suffixes that
   lean on it; these join one sort of names of 200 bytes, in which adjacent prefixes are compared.

Documents are dealt once to chunks by a hash of their id and text, so ids that are missing or repeated
do not heap up; what a chunk sends to a bucket is the
sorted set of its names, so a string that a third of all rows hold comes once from each chunk, and
what returns is a bit for each name. The recursion and the last sort send whole 64-bit names: n of
them give about n * n / 2 ** 65 false matches. What only narrows is sent as 32 bits.

Defined cases: null texts are empty; texts under 200 bytes stay whole; equal rows of at least 200
bytes repeat each other and lose all bytes; an empty table gives no rows; columns not asked for
with ``carry`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import partitions_for

LENGTH = 200
PERIOD = 133
#: A perfect difference cover modulo 133.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SHORT, LONG = LENGTH - PERIOD + 1, LENGTH + PERIOD - 1
BLOCK = 1 << 17

QUESTIONS = "bucket int, chunk int, names binary, within binary"
ANSWERS = "chunk int, step int, bucket int, repeated binary"

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The names of three stretches as one."""
    x = a * _A
    x += b * _B
    x ^= x >> np.uint64(31)
    x += c * _C
    x ^= x >> np.uint64(29)
    x *= _D
    x ^= x >> np.uint64(32)
    return x


def short_names(text: bytes, at: np.ndarray) -> np.ndarray:
    """The names of the 68 bytes from each of some offsets: nine words, triples of them, and a triple of those."""
    words = np.ndarray((max(0, len(text) - 7),), "<u8", text, strides=(1,)) if len(text) > 7 else np.zeros(0, "<u8")
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), BLOCK):
        here = at[lo : lo + BLOCK]
        out[lo : lo + BLOCK] = _triple(*(_triple(*(words[here + k + j] for j in (0, 8, 16))) for k in (0, 24, SHORT - 24)))
    return out


def whole_names(text: bytes, at: np.ndarray) -> np.ndarray:
    """The names of 200 bytes from each of some offsets in order, made of the same triples run by run."""
    words = np.ndarray((max(0, len(text) - 7),), "<u8", text, strides=(1,)) if len(text) > 7 else np.zeros(0, "<u8")
    out = np.empty(len(at), np.uint64)
    cuts = np.flatnonzero((np.diff(at) > LENGTH) | (at[1:] // BLOCK != at[:-1] // BLOCK)) + 1
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(at)), strict=True):
        if hi > lo:
            first, last = at[lo], at[hi - 1]
            w = np.array(words[first : last + LENGTH - 7])
            w = _triple(w[:-16], w[8:-8], w[16:])
            w = _triple(w[: 24 - SHORT], w[24 : 48 - SHORT], w[SHORT - 24 :])
            w = _triple(w[: SHORT - LENGTH], w[66 : 66 + SHORT - LENGTH], w[LENGTH - SHORT :])
            out[lo:hi] = w[at[lo:hi] - first]
    return out


def _within(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are among the chosen ones, which are sorted."""
    if not len(chosen):
        return np.zeros(len(values), bool)
    at = np.searchsorted(chosen, values)
    at[at == len(chosen)] = 0
    return chosen[at] == values


class Chunk:
    """The texts of one chunk, one after another, and what the steps so far say about them."""

    def __init__(self, texts: Iterable[bytes], n_buckets: int):
        texts = list(texts)
        self.n_buckets = n_buckets
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.text = b"".join(texts)
        longest = int(self.lengths.max(initial=0))
        pattern = (np.arange(0, longest + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
        counts = np.searchsorted(pattern, self.lengths - SHORT, "right")
        self.samples = np.concatenate([pattern[:n] + s for n, s in zip(counts, self.starts, strict=True)] or [pattern[:0]])
        self.sample_doc = np.repeat(np.arange(len(texts)), counts)
        self.sample_names = short_names(self.text, self.samples)

    def _name(self, at: np.ndarray) -> np.ndarray:
        """The names of 200 bytes."""
        return _triple(*(short_names(self.text, at + k) for k in (0, 66, LENGTH - SHORT)))

    def _half(self, names: np.ndarray) -> np.ndarray:
        """A bucket and half a name."""
        bucket = (names >> np.uint64(32)) * np.uint64(self.n_buckets) >> np.uint64(32)
        return bucket << np.uint64(32) | names & np.uint64(0xFFFFFFFF)

    def first(self) -> np.ndarray:
        return self._half(self.sample_names)

    def second(self, repeated: np.ndarray) -> np.ndarray:
        """The long names of the repeated samples; keeps which suffixes lean on each of them."""
        at, doc = self.samples[repeated], self.sample_doc[repeated]
        self.anchor_names = self.sample_names[repeated]
        self.lean_from = np.maximum(at - PERIOD + 1, self.starts[doc])
        self.lean_to = np.maximum(np.minimum(at, self.ends[doc] - LENGTH) + 1, self.lean_from)
        self.long = at[at + LONG <= self.ends[doc]]
        return _triple(*(self._name(self.long + k) for k in (0, 66, LONG - LENGTH)))

    def third(self, repeated: np.ndarray) -> np.ndarray:
        """The repeated samples again; ``flags`` tells on which of them an unsettled suffix leans."""
        sure = self.long[repeated]
        self.settled = self._cover(sure, sure + PERIOD)
        open_before = np.concatenate([[0], np.cumsum(~self.settled)])
        self.flags = open_before[self.lean_to] > open_before[self.lean_from]
        return self._half(self.anchor_names)

    def fourth(self, wanted: np.ndarray) -> np.ndarray:
        """The names of the suffixes, settled or not, that lean on a sample on which an unsettled one leans somewhere."""
        self.merged = np.flatnonzero(self._cover(self.lean_from[wanted], self.lean_to[wanted]))
        return whole_names(self.text, self.merged)

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        """A flag for each byte."""
        self.settled[self.merged[repeated]] = True
        at = np.flatnonzero(self.settled)
        return self._cover(at, at + LENGTH)

    def _cover(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = len(self.text)
        edges = np.bincount(lo, minlength=n + 1).astype(np.int32)
        edges -= np.bincount(hi, minlength=n + 1).astype(np.int32)
        return np.cumsum(edges, dtype=np.int32)[:n] > 0


def _sorted_set(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names once each, in order, and which of them come more than once."""
    names = np.sort(names)
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    at = np.flatnonzero(new)
    return names[at], np.diff(np.append(at, len(names))) > 1


def _table(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


#: Steps that send half names, and the one that asks about flags instead of equal names.
HALVES, FLAGGED, STEPS = (1, 3), 3, 4


def _bounds(once: np.ndarray, n_buckets: int, step: int) -> np.ndarray:
    high = once >> np.uint64(32)
    bucket = high if step in HALVES else high * np.uint64(n_buckets) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))


def _questions(number: int, chunk: Chunk, names: np.ndarray, step: int) -> pa.Table:
    once, many = _sorted_set(names)
    if step == FLAGGED:
        many = _within(once, np.unique(names[chunk.flags]))
    bounds = _bounds(once, chunk.n_buckets, step)
    sent = (once & np.uint64(0xFFFFFFFF)).astype("<u4") if step in HALVES else once.astype("<u8")
    rows = [
        (b, number, sent[lo:hi].tobytes(), np.packbits(many[lo:hi]).tobytes())
        for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
        if hi > lo
    ]
    return _table(rows, ("bucket", "chunk", "names", "within"), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))


def _compare(step: int) -> Callable[[pa.Table], pa.Table]:
    """Sort what all chunks sent to a bucket and mark each name that has an equal one beside it.

    In the step that asks about flags, mark each name that some chunk has flagged.
    """

    def compare(table: pa.Table) -> pa.Table:
        kind = "<u4" if step in HALVES else "<u8"
        sent = [np.frombuffer(x, kind) for x in table.column("names").to_pylist()]
        within = [np.unpackbits(np.frombuffer(w, np.uint8))[: len(s)].astype(bool) for w, s in zip(table.column("within").to_pylist(), sent, strict=True)]
        repeated = [s[w] for s, w in zip(sent, within, strict=True)]
        if step != FLAGGED:
            ordered = np.sort(np.concatenate(sent))
            repeated.append(ordered[1:][ordered[1:] == ordered[:-1]])
        repeated = np.unique(np.concatenate(repeated))
        rows = [
            (chunk, step, bucket, np.packbits(_within(s, repeated)).tobytes())
            for chunk, bucket, s in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), sent, strict=True)
        ]
        return _table(rows, ("chunk", "step", "bucket", "repeated"), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))

    return compare


def _answer(answers: pa.Table, step: int, names: np.ndarray, n_buckets: int) -> np.ndarray:
    """Which of a chunk's names the buckets have marked."""
    once, _ = _sorted_set(names)
    bounds = _bounds(once, n_buckets, step)
    flags = np.zeros(len(once), bool)
    for s, b, bits in zip(*(answers.column(c).to_pylist() for c in ("step", "bucket", "repeated")), strict=True):
        if s == step:
            flags[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8))[: bounds[b + 1] - bounds[b]]
    return _within(names, once[flags])


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False, n_chunks: int | None = None, n_buckets: int | None = None) -> DataFrame:
    """doc_id, the carried columns, n_bytes, n_removed, n_spans and what is left (``kept``, bytes).

    With ``as_text``, ``kept`` is a string, without what is left of characters that a cut has broken.

    ``n_chunks`` and ``n_buckets`` follow the session's shuffle width. A chunk's texts and a
    bucket's names are held by one task, so the width should keep a partition's text near 100 MB.
    """
    width = partitions_for(docs.sparkSession)
    n_chunks, n_buckets = n_chunks or 2 * width, n_buckets or max(1, width // 2)
    base = docs.select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")), F.lit(n_chunks)).cast("int").alias("chunk"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)],
    ).repartition(width, "chunk")
    texts = base.select("chunk", "doc_id", "text")
    by_chunk = texts.groupBy("chunk")

    def taken(table: pa.Table, answers: pa.Table | None, steps: int) -> tuple[Chunk, np.ndarray]:
        """The chunk after so many answered steps, and the names or flags that come next."""
        chunk = Chunk(table.column("text").to_pylist(), n_buckets)
        names = chunk.first()
        for step in range(1, steps + 1):
            names = (chunk.second, chunk.third, chunk.fourth, chunk.removed)[step - 1](_answer(answers, step, names, n_buckets))
        return chunk, names

    def ask_first(table: pa.Table) -> pa.Table:
        return _questions(table.column("chunk")[0].as_py(), *taken(table, None, 0), 1)

    def ask_more(steps: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            return _questions(table.column("chunk")[0].as_py(), *taken(table, answers, steps), steps + 1)

        return ask

    shown = base.schema
    names = ["doc_id", *carry, "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()]

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        carried = [table.column(f"carried_{k}") for k in range(len(carry))]
        chunk, gone = taken(table, answers, STEPS)
        n_removed, n_spans, kept = [], [], []
        for lo, hi in zip(chunk.starts, chunk.ends, strict=True):
            own = gone[lo:hi]
            n = int(np.count_nonzero(own))
            n_removed.append(n)
            n_spans.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + int(n and own[0]))
            kept.append(np.frombuffer(chunk.text[lo:hi], np.uint8)[~own].tobytes() if n else chunk.text[lo:hi])
        if as_text:
            kept = [x.decode("utf-8", "ignore") for x in kept]
        columns = [pa.array(x, k) for x, k in zip((chunk.lengths, n_removed, n_spans, kept), kinds, strict=True)]
        return pa.table([table.column("doc_id"), *carried, *columns], names=[f"c{k}" for k in range(len(names))])

    def answered(asked: DataFrame, step: int) -> DataFrame:
        """A step's answers, dealt to the chunks once and read by every later step."""
        return asked.groupBy("bucket").applyInArrow(_compare(step), ANSWERS).repartition(width, "chunk")

    answers = answered(by_chunk.applyInArrow(ask_first, QUESTIONS), 1)
    for steps in range(1, STEPS):
        asked = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(ask_more(steps), QUESTIONS)
        answers = answers.unionByName(answered(asked, steps + 1))
    left = "string" if as_text else "binary"
    kind = dict(zip(carry, [shown[f"carried_{k}"].dataType.simpleString() for k in range(len(carry))], strict=True))
    schema = ", ".join(f"c{k} {kind[c] if c in kind else left if c == 'kept' else 'bigint'}" for k, c in enumerate(names))
    return base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema).toDF(*names)


def repeats_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
