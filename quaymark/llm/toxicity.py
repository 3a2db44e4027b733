"""Toxicity scores by a weighted lexicon.

A text is folded (lower case, homoglyphs and digit substitutions to plain letters, zero-width and
soft-hyphen characters dropped, everything that is no letter to one space) and matched against the
lexicon by one Aho-Corasick automaton, which also holds exception phrases. The lexicon has whole
words and word beginnings with a weight each; a match inside an exception phrase does not count.
The sum of weights, as it is and by length, goes through a logistic curve.

Lexicon, weights, exceptions and curve are learned from at most ``most_rows`` labelled rows, picked
by a hash of doc_id, one for each id; that is the only bound. Entries are whole words of any length and
beginnings of ``SHORTEST`` to ``LONGEST`` letters that at least ``LEAST_TEXTS`` toxic texts hold;
weights are log ratios of the shares of toxic and other texts that hold an entry; phrases of two words
around an entry that only other texts hold become exceptions. ``EXCEPTIONS`` are phrases chosen by
hand to begin with, a parameter. Scoring reads every whole text.

Defined cases: null texts are empty and score as a text without a match; equal texts get equal
scores; a very long text is matched whole, in time that grows with its length; of rows that share an id
one is learned from; without labels of both classes the lexicon is empty and every score is the positive
share (or one half); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import id_text_bucket, labelled_texts, map_texts

MOST_ROWS = 12_000
LEAST_TEXTS = 6
LEAST_WEIGHT = 2.0
SHORTEST, LONGEST = 4, 12

#: Phrases in which a lexicon word is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "circus clown", "pond scum")
#: Letters of other scripts that look like Latin ones, and digits and signs in their place.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ո": "n",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
DROPPED = "­​‌‍⁠﻿"


class Folding(dict):
    """A table for str.translate: unknown characters are looked at once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in DROPPED or unicodedata.combining(c):
            found = ""
        else:
            found = HOMOGLYPHS.get(c) or (c if c.isalpha() else " ")
        self[code] = found
        return found


_folding = Folding()
_inner = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<!\w)[0134578@$]+(?=[^\W\d_])")
_swap = {ord(k): v for k, v in SUBSTITUTIONS.items()}
_marks = re.compile("[0134578@$!]")


def fold(text: str) -> str:
    """Letters and spaces, with a space at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)  # full-width and other forms, and letters with their accents
    text = text.lower()
    if _marks.search(text):
        text = _inner.sub(lambda m: m[0].translate(_swap), text)
    return f" {' '.join(text.translate(_folding).split())} "


def candidates(words: Iterable[str]) -> set[str]:
    """Entries that a text could hold: `` word `` whole, and `` wor`` as a beginning."""
    found = set()
    for w in set(words):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return found


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self._automaton.make_automaton()
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the entries that count: one for a word, the heaviest."""
        if not self.weights:
            return []
        best: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for last, (length, weight) in self.automaton().iter(folded):
            start = last - length + 1
            if weight is None:
                excused.append((start, last))
            elif start not in best or best[start][1] < weight:
                best[start] = (last, weight)
        excused.sort(reverse=True)
        found, until = [], -1
        for start, (last, weight) in sorted(best.items()):
            while excused and excused[-1][0] <= start:
                until = max(until, excused.pop()[1])
            if start >= until - 1:
                found.append((start, last, weight))
        return found

    def inputs(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(m[2] for m in self.matches(folded))
        return float(np.log1p(total)), float(np.log1p(100 * total / (1 + folded.count(" "))))

    def score(self, text: str) -> float:
        a, b = self.inputs(text)
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * a + self.curve[1] * b + self.curve[2], -30, 30))))

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}


def choose(toxic: dict[str, int], other: dict[str, int], n_toxic: int, n_other: int) -> dict[str, float]:
    """Entries and weights: a beginning stands for its continuations unless one of those has nearly all its texts."""
    weight = {e: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((other.get(e, 0) + 0.5) / (n_other + 1))) for e, n in toxic.items()}
    strong = {e for e, w in weight.items() if w >= LEAST_WEIGHT and toxic[e] >= LEAST_TEXTS}
    shadowed = set()
    for e in strong:
        shadowed.update(p for p in (e[:k] for k in range(SHORTEST + 1, len(e))) if p in strong and toxic[e] >= 0.9 * toxic[p])
    kept: dict[str, float] = {}
    for e in sorted(strong - shadowed, key=lambda e: (len(e), e)):
        if not any(e[:k] in kept for k in range(SHORTEST + 1, len(e))):
            kept[e] = weight[e]
    return kept


def logistic_plane(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    a = np.concatenate([x.T, np.ones((1, len(x)))])
    b = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))) @ a.T + 1e-2 * np.eye(3), a @ (y - p) - 1e-2 * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, b))


def train(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = EXCEPTIONS, most_rows: int = MOST_ROWS) -> Model:
    """A model of ``labels.toxic`` from rows whose id is not held out."""
    known = labels.where(id_text_bucket("doc_id", 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("label"))
    rows = labelled_texts(docs, known, most_rows).select("label", "text").persist()

    def counted(wanted: set[str] | None, find):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {0: Counter(), 1: Counter()}
            for batch in batches:
                for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if label in found and (label or wanted is not None):
                        own = find(fold(text.decode("utf-8", "replace")))
                        found[label].update(own if wanted is None else own & wanted)
            for label, counts in found.items():
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(counts), pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["label", "entry", "n"])

        total = rows.mapInArrow(scan, "label int, entry string, n bigint").groupBy("label", "entry").agg(F.sum("n").alias("n"))
        return total.where(F.col("n") >= LEAST_TEXTS) if wanted is None else total

    def of(frame: DataFrame, label: int) -> dict[str, int]:
        return {r.entry: r.n for r in frame.collect() if r.label == label}

    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = float(np.clip(sizes.get(1, 0) / total if total else 0.5, 0.01, 0.99))
    if len({0, 1} & set(sizes)) < 2:
        rows.unpersist()
        return Model({}, frozenset(exceptions), (0.0, 0.0, float(np.log(share / (1 - share)))))
    whole = lambda folded: candidates(folded.split())
    toxic = of(counted(None, whole), 1)
    other = of(counted(set(toxic), whole), 0)
    model = Model(choose(toxic, other, sizes[1], sizes[0]), frozenset(exceptions))

    def around(folded: str) -> set[str]:
        found = set()
        for start, end, _ in model.matches(folded):
            stop = folded.index(" ", max(end, start + 1)) if folded[end] != " " else end
            before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
            found |= {folded[before + 1 : stop]} if before >= 0 else set()
            found |= {folded[start + 1 : after]} if after >= 0 else set()
        return found

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(label, p) for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in around(fold(text.decode("utf-8", "replace")))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())], names=["label", "phrase"])

    excused = rows.mapInArrow(phrases, "label int, phrase string").groupBy("phrase").agg(F.count_if(F.col("label") == 0).alias("other"), F.count_if(F.col("label") == 1).alias("toxic"))
    learned = [r.phrase for r in excused.where((F.col("other") >= 3) & (F.col("toxic") == 0)).collect()]
    model = Model(model.weights, frozenset(exceptions) | frozenset(learned))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.inputs(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["label", "a", "b"])

    table = rows.mapInArrow(measured, "label int, a double, b double").toPandas().sort_values(["label", "a", "b"])
    rows.unpersist()
    return Model(model.weights, model.exceptions, logistic_plane(table[["a", "b"]].to_numpy(), (table["label"] == 1).to_numpy(float)))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, score (0 to 1, higher: the label is likelier 1) and predicted, of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: list[bytes]) -> list[pa.Array]:
        score = sent.value.score
        return [pa.array([score(t.decode("utf-8", "replace")) for t in texts], pa.float64())]

    return map_texts(docs, "score double", scores, carry).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, train(docs, labels)).select("doc_id", (id_text_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
