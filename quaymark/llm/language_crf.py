"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language. A word's features are its letter n-grams with its edges
(those at an edge are affixes) and its place in the lexicon of frequent words; neighbouring words
share learned transitions. Forward-backward gives each word its marginal probabilities, so that
code-switched text is labelled word by word. A text's language is the one with the largest expected
share of words, and that share is the score.

Training takes at most ``most_docs`` documents, picked by a hash of doc_id, one for each id, and at
most ``most_words`` of their words, the same share for each language. All of the documents have a part
in that: a long one gives stretches spread over its whole length. Their words carry the document's
language; stretches of documents in different languages are laid end to end, so that the transitions
see switches. Prediction reads every whole text; a word of over ``LETTERS`` letters is
labelled in parts of that length.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled row
to learn from every text is ``und``; equal texts get equal results; a very long text is labelled whole,
as one chain; of rows that share an id one is learned from; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import id_text_bucket, labelled_texts, map_texts

MOST_DOCS = 3_000
MOST_WORDS = 240_000
LETTERS = 24
DIMENSIONS = 1 << 17
SIZES = (2, 3, 4, 5)
LEXICON = 400
SPAN = 48
WORDS_AT_ONCE = 1 << 15
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]{1,%d}" % LETTERS)


def words_of(text: str) -> list[str]:
    """Runs of letters; one of over ``LETTERS`` letters comes in parts, so that every letter counts."""
    found = _WORD.findall(text.lower())
    return found if "".join(found).isalpha() else [w for w in ("".join(filter(str.isalpha, w)) for w in found) if w]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters with a 1 before and a 2 after each word, as rows, and how many each has."""
    held = np.array([w[:LETTERS] for w in words], f"<U{LETTERS}").view("<u4").reshape(len(words), LETTERS)
    n = (held != 0).sum(axis=1)
    rows = np.zeros((len(words), LETTERS + 2), np.uint64)
    rows[:, 0] = 1
    rows[:, 1:-1] = held
    rows[np.arange(len(words)), n + 1] = 2
    return rows, n + 2


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size and place: the words that have an n-gram there, and its feature id."""
    rows, n = _letters(words)
    for size in SIZES:
        for at in range(LETTERS + 3 - size):
            own = np.flatnonzero(n >= at + size)
            if not len(own):
                break
            h = np.full(len(own), size, np.uint64)
            for k in range(size):
                h = (h ^ rows[own, at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield own, (h % np.uint64(DIMENSIONS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """The score of each language for each word."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for lo in range(0, len(words), WORDS_AT_ONCE):
            part = out[lo : lo + WORDS_AT_ONCE]
            for own, ids in _grams(words[lo : lo + WORDS_AT_ONCE]):
                part[own] += self.weights[ids]
        if words:
            get = self.lexicon.get
            known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            own = np.flatnonzero(known >= 0)
            out[own] += self.weights[DIMENSIONS + known[own]]
        return out


def forward_backward(potentials: np.ndarray, active: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of chains laid side by side, longest first.

    ``potentials`` holds the words at place 0 of all chains, then those at place 1, and so on;
    ``active`` tells how many chains have each place.
    """
    at = np.concatenate([[0], np.cumsum(active)])
    ahead = np.empty_like(potentials)
    ahead[: at[1]] = now = potentials[: at[1]] / potentials[: at[1]].sum(axis=1, keepdims=True)
    for t in range(1, len(active)):
        now = (now[: active[t]] @ moves) * potentials[at[t] : at[t + 1]]
        now /= now.sum(axis=1, keepdims=True)
        ahead[at[t] : at[t + 1]] = now
    back = np.ones((active[-1], potentials.shape[1]), potentials.dtype)
    for t in range(len(active) - 2, -1, -1):
        new = np.ones((active[t], potentials.shape[1]), potentials.dtype)
        n = active[t + 1]
        new[:n] = (back[:n] * potentials[at[t + 1] : at[t + 2]]) @ moves.T
        new[:n] /= new[:n].sum(axis=1, keepdims=True)
        ahead[at[t + 1] : at[t + 2]] *= back
        back = new
    ahead[: at[1]] *= back
    ahead /= ahead.sum(axis=1, keepdims=True)
    return ahead


def _potentials(emissions: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), -60)).astype(np.float64)


def word_marginals(model: Model, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each text with a word: its position and its words' marginals, one row a word."""
    vocabulary: dict[str, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)) for words in texts]
    score = _potentials(model.emissions(list(vocabulary))) if vocabulary else np.zeros((0, 1))
    moves = np.exp(model.transitions)
    order = sorted((k for k in range(len(texts)) if len(ids[k])), key=lambda k: -len(ids[k]))
    while order:
        group, n = [], 0
        while order and (not group or n < 100_000):
            group.append(order.pop(0))
            n += len(ids[group[-1]])
        lengths = np.array([len(ids[k]) for k in group])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        place = np.concatenate([np.arange(m) for m in lengths])
        flat = np.concatenate([[0], np.cumsum(active)])[place] + np.repeat(np.arange(len(group)), lengths)
        words = np.empty(n, np.int32)
        words[flat] = np.concatenate([ids[k] for k in group])
        found = forward_backward(score[words], active, moves)[flat]
        for k, rows in zip(group, np.split(found, np.cumsum(lengths)[:-1]), strict=True):
            yield k, rows


def spread(words: list[str], most: int) -> list[list[str]]:
    """Stretches of ``SPAN`` words, at most ``most`` words in all, evenly over the whole text."""
    starts = range(0, len(words), SPAN)
    n = min(len(starts), max(1, most // SPAN))
    return [words[k : k + SPAN] for k in (starts[i * len(starts) // n] for i in range(n))]


def share_of_each(lengths: list[int], most: int) -> int:
    """The largest number of words that each text may give so that all give ``most`` at most."""
    left, above = most, len(lengths)
    for n in sorted(lengths):
        if n * above >= left:
            return left // above
        left, above = left - n, above - 1
    return max(lengths, default=0)


def fit(texts: list[str], langs: list[str], rounds: int = 60, most_words: int = MOST_WORDS) -> Model:
    """Weights and transitions of largest likelihood with a little ridge, by Adam steps over all chains."""
    languages = sorted(set(langs))
    number = {x: k for k, x in enumerate(languages)}
    runs: list[list[tuple[str, int]]] = []
    lengths = [len(words_of(t)) for t in texts]
    shares = {x: share_of_each([n for n, y in zip(lengths, langs, strict=True) if y == x], most_words // len(languages)) for x in languages}
    spans = [[(w, number[lang]) for w in part] for text, n, lang in zip(texts, lengths, langs, strict=True) if n for part in spread(words_of(text), shares[lang])]
    if not spans:
        return Model(languages, np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros((len(languages),) * 2), {})
    picked = np.random.default_rng(7).permutation(len(spans))
    halves = [spans[i][: len(spans[i]) // 2] if k % 4 < 2 else spans[i] for k, i in enumerate(picked)]
    del spans
    for k in range(0, len(halves), 4):
        runs += [x for x in (sum(halves[k : k + 2], []), *halves[k + 2 : k + 4]) if x]
    del halves
    counts: dict[str, int] = {}
    for run in runs:
        for w, _ in run:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[: LEXICON * len(languages)])}
    vocabulary = {w: k for k, w in enumerate(counts)}
    words = list(vocabulary)
    known = np.array([lexicon.get(w, -1) for w in words])
    pairs = [(own.astype(np.int32), ids.astype(np.int32)) for own, ids in _grams(words)]
    pairs.append((np.flatnonzero(known >= 0).astype(np.int32), (DIMENSIONS + known[known >= 0]).astype(np.int32)))
    owner, feature = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    del pairs
    runs.sort(key=len, reverse=True)
    lengths = np.array([len(r) for r in runs])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    place = np.concatenate([np.arange(m) for m in lengths])
    flat = np.concatenate([[0], np.cumsum(active)])[place] + np.repeat(np.arange(len(runs)), lengths)
    word, truth = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
    word[flat] = [vocabulary[w] for r in runs for w, _ in r]
    truth[flat] = [y for r in runs for _, y in r]
    del runs
    at = np.concatenate([[0], np.cumsum(active)])
    follows = np.concatenate([np.stack([np.arange(at[t], at[t] + active[t + 1]), np.arange(at[t + 1], at[t + 2])]) for t in range(len(active) - 1)] or [np.zeros((2, 0), int)], axis=1)
    k = len(languages)
    size = DIMENSIONS + len(lexicon)
    theta, m, v = (np.zeros(size * k + k * k) for _ in range(3))
    for step in range(1, rounds + 1):
        weights, moves = theta[: size * k].reshape(size, k), theta[size * k :].reshape(k, k)
        scores = np.stack([np.bincount(owner, weights[feature, j], len(words)) for j in range(k)], axis=1)
        potentials = _potentials(scores[word])
        marginal = forward_backward(potentials, active, np.exp(moves))
        grad_word = -marginal
        grad_word[np.arange(len(truth)), truth] += 1
        by_word = np.stack([np.bincount(word, grad_word[:, j], len(words)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(feature, by_word[owner, j], size) for j in range(k)], axis=1)
        seen = np.bincount(truth[follows[0]] * k + truth[follows[1]], minlength=k * k).reshape(k, k)
        joint = _pairs(potentials, active, np.exp(moves), at)
        g = np.concatenate([(grad - 0.02 * weights).ravel(), (seen - joint - 0.02 * moves).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(languages, theta[: size * k].reshape(size, k).astype(np.float32), theta[size * k :].reshape(k, k), lexicon)


def _pairs(potentials: np.ndarray, active: np.ndarray, moves: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The expected number of each transition, by forward and backward vectors of each place."""
    ahead = [potentials[: at[1]] / potentials[: at[1]].sum(axis=1, keepdims=True)]
    for t in range(1, len(active)):
        now = (ahead[-1][: active[t]] @ moves) * potentials[at[t] : at[t + 1]]
        ahead.append(now / now.sum(axis=1, keepdims=True))
    total, back = np.zeros_like(moves), np.ones((active[-1], len(moves)))
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        tail = back[:n] * potentials[at[t + 1] : at[t + 2]]
        pair = ahead[t][:n, :, None] * moves[None] * tail[:, None, :]
        total += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        new = np.ones((active[t], len(moves)))
        new[:n] = tail @ moves.T
        new[:n] /= new[:n].sum(axis=1, keepdims=True)
        back = new
    return total


def train(docs: DataFrame, most_docs: int = MOST_DOCS, most_words: int = MOST_WORDS) -> Model:
    """A model of ``lang`` from documents whose id is not held out."""
    lang = F.when(id_text_bucket("doc_id", 4) != 2, F.col("lang").cast("string"))
    table = labelled_texts(docs, docs.select("doc_id", lang.alias("label")), most_docs, lang).toArrow()
    found = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True))
    del table
    texts, langs = [r[2].decode("utf-8", "replace") for r in found], [r[1] for r in found]
    del found
    return fit(texts, langs, most_words=most_words)


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def labels(texts: list[bytes]) -> list[pa.Array]:
        m = sent.value
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for k, rows in word_marginals(m, [words_of(t.decode("utf-8", "replace")) for t in texts]) if m.languages else ():
            share = rows.mean(axis=0)
            langs[k], scores[k] = m.languages[int(share.argmax())], min(1.0, float(share.max()))
        return [pa.array(langs, pa.string()), pa.array(scores)]

    return map_texts(docs, "lang_pred string, score double", labels, carry)


def language_digest(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs)).select("doc_id", (id_text_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
