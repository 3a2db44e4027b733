"""Quality scores by naive Bayes support vectors.

Features are indicators of hashed n-grams of one and two words, and of one and two word shapes (a
shape keeps the order of letter cases, digits and symbols in a word, without repeats), with two
marks for the share of repeated three-word windows and for the length. Each indicator is scaled by
the log ratio of its share in the two classes; a linear model with hinge loss is fitted to the
scaled vectors of unit length by dual coordinate descent; a logistic curve, fitted to rows that the
descent has not seen, turns margins into scores.

Fitting takes at most ``most_rows`` labelled rows, picked by a hash of doc_id, one for each id; scoring
reads every whole text.

Defined cases: null texts are empty and get the score of a vector without n-grams; rows without a
label only get scores; equal texts get equal scores; a very long text is scored whole; of rows that share
an id one is learned from; labels of one class only, or none, give that
class's share (or one half) as every score; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import id_text_bucket, labelled_texts, map_texts

MOST_ROWS = 8_000
DIMENSIONS = 1 << 19
CACHED_WORDS = 100_000

_CLASSES = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_known: dict[bytes, int] = {}


def _hashes(word: bytes) -> int:
    """A word's hash in the high half and its shape's in the low one."""
    found = zlib.crc32(word.lower()) << 31 | zlib.crc32(_RUNS.sub(rb"\1", word.translate(_CLASSES))) >> 1
    if len(_known) < CACHED_WORDS and len(word) < 64:
        _known[word] = found
    return found


def features(text: bytes) -> np.ndarray:
    """The ids of the features that a text has, once each, unordered."""
    words = text.split()
    get = _known.get
    both = np.fromiter((get(w) or _hashes(w) for w in words), np.int64, len(words)).view(np.uint64)
    word, shape = both >> np.uint64(31), both & np.uint64(0x7FFFFFFF)
    pair, shapes = (x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] for x in (word, shape))
    ids = np.concatenate([_fold(x, salt) for salt, x in enumerate((word, pair, shape, shapes))])
    share = 0
    if len(pair) > 1:
        three = np.sort(pair[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[2:])
        share = int(10 * np.count_nonzero(three[1:] == three[:-1]) / len(three)) + 1
    ids = np.append(ids, [share, 32 + len(words).bit_length()])
    return ids[_first(ids)]


def _fold(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt + 1)) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int64)


_seen = np.zeros(DIMENSIONS, np.int32)


def _first(ids: np.ndarray) -> np.ndarray:
    """Which ids are the last of their kind, found without sorting."""
    at = np.arange(len(ids), dtype=np.int32)
    _seen[ids] = at
    return _seen[ids] == at


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratios[ids]
        norm = float(np.sqrt(np.dot(r, r))) or 1.0
        return float(np.dot(self.weights[ids], r)) / norm + self.bias

    def score(self, ids: np.ndarray) -> float:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.offset, -30, 30)))


@dataclass(frozen=True)
class Scaled:
    """Rows of ids with their ratios at length one, which are made anew each time: of all rows only the ids are held."""

    ids: list[np.ndarray]
    ratios: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k >= len(self.ids):
            raise IndexError(k)
        x = self.ratios[self.ids[k]]
        return self.ids[k], x / (np.sqrt(np.dot(x, x)) or 1.0)


def descend(rows: Sequence[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of least ``|w|^2 / 2 + cost * sum of hinges``, by dual coordinate descent."""
    w, bias, dual = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    norms = np.array([np.dot(x, x) + 1 for _, x in rows])
    for order in (np.random.default_rng(k).permutation(len(rows)) for k in range(rounds)):
        for i in order:
            ids, x = rows[i]
            slope = signs[i] * (np.dot(w[ids], x) + bias) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), cost)
            if new != dual[i]:
                step = (new - dual[i]) * signs[i]
                w[ids] += step * x
                bias += step
                dual[i] = new
    return w, bias


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's steps with a little ridge."""
    a = np.stack([x, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))) @ a.T + 1e-3 * np.eye(2), a @ (y - p) - 1e-3 * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    flat = np.zeros(DIMENSIONS)
    if len(set(labels.tolist())) < 2:
        p = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return Model(flat, flat, 0.0, 0.0, float(np.log(p / (1 - p))))
    rest = np.arange(len(rows)) % 5 == 0
    counts = {k: np.ones(DIMENSIONS) for k in (0, 1)}
    for ids, y in zip(rows, labels.tolist(), strict=True):
        counts[y][ids] += 1
    ratios = np.log(counts[1] / (labels == 1).sum()) - np.log(counts[0] / (labels == 0).sum())
    ratios[(counts[0] + counts[1]) <= 3] = 0.0
    w, bias = descend(Scaled([r for r, held in zip(rows, rest, strict=True) if not held], ratios), np.where(labels[~rest] == 1, 1.0, -1.0))
    margins = np.array([np.dot(w[ids], x) + bias for ids, x in Scaled(rows, ratios)])
    use = rest if len(set(labels[rest].tolist())) == 2 else ~rest
    return Model(ratios, w, bias, *logistic(margins[use], labels[use]))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """A model of ``labels[column]`` from rows whose id is not held out."""
    known = labels.where(id_text_bucket("doc_id", 5) != 0).select("doc_id", F.col(column).cast("int").alias("label"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(features(t)).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "ids"])

    table = labelled_texts(docs, known, most_rows).mapInArrow(scan, "doc_id bigint, label int, ids binary").toArrow()
    # The ids stay where Arrow has them, 4 bytes each; only their order is made here.
    held = table.column("ids").combine_chunks()
    ids = [np.frombuffer(x.as_buffer(), "<i4") for x in held]
    keys = table.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(str(keys[k]).encode()), keys[k], ids[k].tobytes()))
    known = table.column("label").to_numpy()
    return fit([ids[k] for k in order], np.array([known[k] for k in order], np.int64))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, score (0 to 1, higher: the label is likelier 1) and predicted, of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.ratios.astype(np.float32), model.weights.astype(np.float32), model.bias, model.slope, model.offset))

    def scores(texts: list[bytes]) -> list[pa.Array]:
        score = sent.value.score
        return [pa.array([float(score(features(t))) for t in texts], pa.float64())]

    return map_texts(docs, "score double", scores, carry).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, train(docs, labels)).select("doc_id", (id_text_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
