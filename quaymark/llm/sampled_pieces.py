"""Sampled SentencePiece segmentations, reproducible by row, and their lossless decoding.

A text's piece lattice has a state at each character and an edge for each vocabulary piece. Forward
filtering sums the weights of all ways to each state; backward sampling then walks from the end,
taking each edge with its share of that sum, so a whole segmentation comes with probability in
proportion to the product of its pieces' weights. No piece spans from a letter to a space, so the
lattice falls apart into words: the forward sums of equal words are computed once, and the walks of
all words of a batch are taken in step. The random numbers are hashes of seed, row key, word and
place: a row gets the same pieces wherever and however often it is computed.

A BPE model stores the order of its merges, not probabilities; piece number r in that order is given
the weight ``(r + 10) ** -sharpness`` (Zipf's law at 1). A character without a piece of its own
becomes the pieces of its UTF-8 bytes, and so does the space mark itself, so that decoding is exact.

Memory is bounded by characters, not rows: texts are taken in slices of about ``SLICE`` characters, a
long text over several, and a giant word (without a space) in stretches, all with the same result.

Defined cases: a very long text or word is encoded whole; a null or empty text has no pieces and decodes to an empty text; equal rows (same id
and text) get equal pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaymark.llm.common import bare_texts, slices

MARK = "▁"
_SEGMENTS = re.compile(r" *[^ ]+| +")


class Lattice:
    """A vocabulary with weights, and the backward choices that it gives words."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.edges: dict[str, tuple[int, float]] = {}
        self.first_byte = model.piece_to_id("<0x00>")
        self.text = [b""] * size
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.text[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.text[k] = piece.replace(MARK, " ").encode()
                rank = min(size, max(0.0, -model.get_score(k)))
                self.edges[piece] = (k, (rank + 10) ** -sharpness)
        self.rare = (size + 10.0) ** -sharpness
        self.longest = max(map(len, self.edges))
        self._table()

    def _table(self) -> None:
        """A hash table of the pieces and their beginnings by a polynomial of their characters, for many look-ups at once."""
        found: dict[int, tuple[int, float]] = {}
        for piece, edge in self.edges.items():
            key = 0
            for c in piece:
                found.setdefault(key, (-1, 0.0))
                key = (key * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
            found[key] = edge
        bits = len(found).bit_length() + 1
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.keys, self.used, self.ids, self.weights = np.zeros(self.slots, np.uint64), np.zeros(self.slots, bool), np.full(self.slots, -1, np.int32), np.zeros(self.slots)
        keys = np.array(list(found), np.uint64)
        self.probes = 1
        for key, place, (k, weight) in zip(keys, _slot(keys, self.shift).tolist(), found.values(), strict=True):
            probe = 1
            while self.used[place]:
                place, probe = (place + 1) % self.slots, probe + 1
            self.keys[place], self.used[place], self.ids[place], self.weights[place] = key, True, k, weight
            self.probes = max(self.probes, probe)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The table's slot of each piece or beginning of one, or -1."""
        at = _slot(keys, self.shift).astype(np.int64)
        found = np.where((self.keys[at] == keys) & self.used[at], at, -1)
        left = np.flatnonzero((found < 0) & self.used[at])
        for _ in range(1, self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) % self.slots
            hit = (self.keys[at[left]] == keys[left]) & self.used[at[left]]
            found[left[hit]] = at[left[hit]]
            left = left[~hit & self.used[at[left]]]
        return found

    def choices(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length, by their character numbers: edges into each state in order.

        Gives the number of edges of each state but the first, and their starts, pieces and cumulated
        shares. A negative piece, less one, stands for the bytes of the character with that number.
        """
        n, length = codes.shape
        hashed = np.zeros((length + 1, n), np.uint64)
        for k in range(length):
            # Spaces are marks here, and a mark in the text is a character without a piece.
            shown = np.where(codes[:, k] == ord(MARK), 0x110000, np.where(codes[:, k] == 32, ord(MARK), codes[:, k]))
            hashed[k + 1] = hashed[k] * _BASE + (shown + 1).astype(np.uint64)
        power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        # Edges into each state as (start, words, pieces, weights): from each start, words are followed only
        # as long as what follows begins a piece.
        edges: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
        for start in range(length):
            alive = np.arange(n)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                slot = self.look_up(hashed[end][alive] - hashed[start][alive] * power[end - start])
                ids = np.where(slot >= 0, self.ids[slot], -1)
                known = ids >= 0
                if end == start + 1:
                    weight = np.where(known, self.weights[slot], self.rare)
                    edges[end].append((start, alive, np.where(known, ids, -1 - codes[:, start].astype(np.int64)).astype(np.int32), weight))
                elif known.any():
                    edges[end].append((start, alive[known], ids[known], self.weights[slot[known]]))
                alive = alive[slot >= 0]
                if not len(alive):
                    break
        sums, parts = np.zeros((length + 1, n)), []
        sums[0] = 1.0
        for end in range(1, length + 1):
            total, shares = np.zeros(n), []
            for start, words, _, weight in edges[end]:
                total[words] += sums[start][words] * weight
                shares.append(total[words])
            for (start, words, ids, _), share in zip(edges[end], shares, strict=True):
                share /= total[words]
                if start == end - 1:
                    share[:] = 1.0
                parts.append((words * length + end - 1, np.full(len(words), start, np.int32), ids, share))
            sums[end] = total
            sums[max(0, end - self.longest + 1) : end + 1] /= total
        state, starts, pieces, shares = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(state, kind="stable")
        return np.bincount(state, minlength=n * length), starts[order], pieces[order], shares[order]

    def long_choices(self, segment: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for one long word, without arrays over all its places."""
        return self.stretch(segment, _shown(segment), 0, len(segment), [1.0])[:4]

    def stretch(self, segment: str, shown: str, lo: int, hi: int, sums: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[float]]:
        """The same for the states after ``lo`` up to ``hi``; ``sums`` are those of the last places up to ``lo``, then up to ``hi``."""
        get, counts, starts, pieces, shares = self.edges.get, [], [], [], []
        for end in range(lo + 1, hi + 1):
            before, total, n = end - len(sums), 0.0, len(starts)
            for start in range(before, end):
                edge = get(shown[start:end])
                if edge is None and start == end - 1:
                    edge = (-1 - ord(segment[start]), self.rare)
                if edge is not None:
                    total += sums[start - before] * edge[1]
                    starts.append(start)
                    pieces.append(edge[0])
                    shares.append(total)
            shares[n:] = [x / total for x in shares[n:]]
            shares[-1] = 1.0
            counts.append(len(starts) - n)
            sums = [x / total for x in (*sums, total)][-self.longest :]
        return np.array(counts, np.int32), np.array(starts, np.int32), np.array(pieces, np.int32), np.array(shares), sums

    def walk(self, segment: str, stream: np.uint64) -> np.ndarray:
        """The sampled pieces of a word too long to hold its edges: sums at stretches' ends are kept, edges made again."""
        shown, sums = _shown(segment), [[1.0]]
        cuts = [*range(0, len(segment), STRETCH), len(segment)]
        for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
            sums.append(self.stretch(segment, shown, lo, hi, sums[-1])[4])
        out, at = [], len(segment)
        for k in range(len(cuts) - 2, -1, -1):
            lo, hi = cuts[k], cuts[k + 1]
            if at <= lo:
                continue
            counts, starts, pieces, shares, _ = self.stretch(segment, shown, lo, hi, sums[k])
            first = np.cumsum(counts) - counts
            u = _uniform(stream + np.arange(lo + 1, hi + 1).astype(np.uint64) * _PLACE)
            while at > lo:
                edge, last = int(first[at - lo - 1]), int(first[at - lo - 1] + counts[at - lo - 1]) - 1
                while edge < last and shares[edge] <= u[at - lo - 1]:
                    edge += 1
                out.append(int(pieces[edge]))
                at = int(starts[edge])
        return np.array(out[::-1], np.int32)


def _shown(segment: str) -> str:
    """Spaces are marks in pieces, and a mark in the text is a character without a piece."""
    return segment.replace(MARK, "\x00").replace(" ", MARK)


#: Words of over ``LONG`` characters or ``FEW`` of a length are taken one by one, those of over ``GIANT``
#: characters in stretches; a slice has about so many characters, and edges are kept for about so many states.
LONG, FEW, GIANT, STRETCH, SLICE, MOST_STATES = 48, 64, 1 << 16, 4096, 1 << 20, 1 << 20
_PLACE = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0x2545F4914F6CDD1D)


def _slot(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((keys ^ keys >> np.uint64(33)) * np.uint64(0x9E3779B97F4A7C15)) >> shift


@lru_cache(maxsize=2)
def lattice(path: str, sharpness: float) -> Lattice:
    return Lattice(path, sharpness)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Words:
    """The edges of words met so far, flat: word k's states begin at base[k], a state's edges at first[state]."""

    def __init__(self, model: Lattice):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths = self.base = self.first = np.zeros(0, np.int64)
        self.starts, self.pieces, self.shares, self.most = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), 1

    def numbers(self, segments: list[list[str]]) -> np.ndarray:
        """The number of each word in order; a giant one has -1."""
        if len(self.first) > MOST_STATES:
            self.clear()
        known, n = self.known, len(self.known)
        word = np.array([known.setdefault(s, len(known)) if len(s) <= GIANT else -1 for own in segments for s in own], np.int64)
        self._add(list(itertools.islice(known, n, None)))
        return word

    def _add(self, spelled: list[str]) -> None:
        by_length: dict[int, list[int]] = {}
        for k, segment in enumerate(spelled):
            by_length.setdefault(len(segment), []).append(k)
        lengths, base = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), np.int64)
        parts, states = [], len(self.first)
        for length, own in by_length.items():
            most_words = max(1, (1 << 19) // (length * min(length, self.model.longest)))
            for lo in range(0, len(own), most_words):
                group = own[lo : lo + most_words]
                if length > LONG or len(group) < FEW:  # the same numbers either way
                    parts += [self.model.long_choices(spelled[k]) for k in group]
                else:
                    codes = np.frombuffer("".join([spelled[k] for k in group]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)
                    parts.append(self.model.choices(codes))
                lengths[group], base[group] = length, states + length * np.arange(len(group))
                states += length * len(group)
        if parts:
            counts, starts, pieces, shares = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.first = np.concatenate([self.first, len(self.starts) + np.cumsum(counts) - counts])
            self.starts, self.pieces, self.shares = np.concatenate([self.starts, starts]), np.concatenate([self.pieces, pieces]), np.concatenate([self.shares, shares])
            self.lengths, self.base = np.concatenate([self.lengths, lengths]), np.concatenate([self.base, base])
            self.most = max(self.most, int(counts.max()))


def _slices(texts: list[str]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """Stretches of about ``SLICE`` characters: (text, number of its first word here, words). A long text has several."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        if 0 < len(text) <= SLICE:
            held.append((row, 0, _SEGMENTS.findall(f" {text}")))
            size += len(text)
        elif text:
            first, own = 0, []
            for found in _SEGMENTS.finditer(f" {text}"):
                own.append(found[0])
                size += len(found[0])
                if size >= SLICE:
                    yield [(row, first, own)]
                    first, own, size = first + len(own), [], 0
            held = [(row, first, own)] if own else []
    if held:
        yield held


def sample(model: Lattice, keys: list[str], texts: list[str], seed: int, words: Words | None = None) -> list[np.ndarray]:
    """One segmentation of each text, as piece ids; ``words`` keeps edges from call to call."""
    words, found = words or Words(model), [[] for _ in texts]
    for part in _slices(texts):
        for (row, _, _), ids in zip(part, _sampled(words, keys, part, seed), strict=True):
            found[row].append(ids)
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in found]


def _sampled(words: Words, keys: list[str], part: list[tuple[int, int, list[str]]], seed: int) -> list[np.ndarray]:
    """The piece ids of each stretch of one slice; the walks of all its words are taken in step."""
    model, per_text = words.model, np.array([len(own) for _, _, own in part], np.int64)
    word = words.numbers([own for _, _, own in part])
    row_key = np.array([zlib.crc32(keys[row].encode()) for row, _, _ in part], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    number = np.arange(len(word)) - np.repeat(np.cumsum(per_text) - per_text - np.array([first for _, first, _ in part]), per_text)
    stream = _mix(np.repeat(row_key, per_text) + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at, plain = np.zeros(len(word), np.int32), word >= 0
    at[plain] = words.lengths[word[plain]]
    live = np.flatnonzero(at)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    counts = np.zeros(len(word), np.int64)
    while len(live):
        state = words.base[word[live]] + at[live] - 1
        u = _uniform(stream[live] + at[live].astype(np.uint64) * _PLACE)
        edge, left = words.first[state], np.arange(len(live))
        for _ in range(words.most):
            left = left[words.shares[edge[left]] <= u[left]]
            if not len(left):
                break
            edge[left] += 1
        steps.append((live.astype(np.int32), words.pieces[edge]))
        counts[live] += 1
        at[live] = words.starts[edge]
        live = live[at[live] > 0]
    spelled = [s for _, _, own in part for s in own] if not plain.all() else []
    giant = {int(k): model.walk(spelled[k], stream[k]) for k in np.flatnonzero(~plain)}
    for k, ids in giant.items():
        counts[k] = len(ids)
    ends = np.cumsum(counts)
    flat = np.empty(int(counts.sum()), np.int32)
    for k, (own, ids) in enumerate(steps):
        flat[ends[own] - 1 - k] = ids
    for k, ids in giant.items():
        flat[ends[k] - len(ids) : ends[k]] = ids
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
    out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [_spell(model, ids) if len(ids) and ids.min() < 0 else ids for ids in out]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _spell(model: Lattice, ids: np.ndarray) -> np.ndarray:
    out: list[int] = []
    for k in ids.tolist():
        out += [k] if k >= 0 else [model.first_byte + b for b in chr(-1 - k).encode("utf-8", "surrogatepass")]
    return np.array(out, np.int32)


def decode(model: Lattice, ids: np.ndarray) -> bytes:
    """The text of some pieces, as UTF-8; the space before the first word goes."""
    return b"".join(map(model.text.__getitem__, ids.tolist()))[1:]


def _encoded(words: Words, batch: pa.RecordBatch, seed: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of a batch, few at a time by their bytes, and the pieces of each."""
    for rows in slices(batch, 1, SLICE):
        yield rows, sample(words.model, [str(k) for k in rows.column(0).to_pylist()], [t.decode("utf-8", "surrogatepass") for t in rows.column(1).to_pylist()], seed, words)


def encode_sampled(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """doc_id, n_ids and ids (little-endian unsigned 32-bit) of one sampled segmentation of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lattice(model_path, sharpness))
        for batch in batches:
            for rows, found in _encoded(words, batch, seed):
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())], names=["doc_id", "n_ids", "ids"]
                )

    return bare_texts(docs).mapInArrow(scan, "doc_id bigint, n_ids bigint, ids binary")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids and the text that they spell (``decoded``, UTF-8 bytes)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path, 1.0)
        for batch in batches:
            texts = [decode(model, np.frombuffer(x, "<u4")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.binary())], names=["doc_id", "n_ids", "ids", "decoded"])

    return encoded.select("doc_id", "n_ids", "ids").mapInArrow(scan, "doc_id bigint, n_ids bigint, ids binary, decoded binary")


def sampled_digest(docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """Pieces by number and CRC-32, and the text that they decode to by length and SHA-256, in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lattice(model_path, sharpness))
        for batch in batches:
            for rows, found in _encoded(words, batch, seed):
                n, crc, size, sha = [], [], [], []
                for ids in found:
                    text = decode(words.model, ids)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    size.append(len(text))
                    sha.append(hashlib.sha256(text).hexdigest())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, t) for x, t in zip((n, crc, size, sha), kinds, strict=True))], names=["doc_id", "n_ids", "ids_crc32", "n_bytes", "decoded_sha256"])

    return bare_texts(docs).mapInArrow(scan, "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_bytes bigint, decoded_sha256 string")
