"""Spelling variants: words one error apart, found by automata in both directions.

Words are counted over all texts. Of two words one error apart, each has a half of the other unchanged:
if the error lies in the second half of a word of m code points, the other word begins with its first
m // 2, else it ends with its last m - m // 2. So each word is asked for twice: a forward automaton is walked exactly
along the first half and may spend one error on the rest, a backward automaton (of the words read from their ends) does the same with the
second half. Words that a backward walk finds although they share the first half too are left to the forward walk, so that each pair is
found once.

The automata are minimal and acyclic, and their states hold how many words they lead to; the sum of those before a
path is the word's number, 0 to n - 1 in order, a perfect hash into the arrays of counts beside the automaton.

Scale: a question and its answers share the exact half, so both are dealt by it: a word is asked for under its own
half, and stands in the dictionary under its halves of the lengths that words of one code point less, as many, or one more have
(two keys a direction at most). Keys are dealt by hash to shards of about ``SHARD`` entries; a
half that is shared by more words than that has its dictionary split over several shards, and its questions go to each.
Links of one word are bounded by its length times the alphabet, so they are gathered by word. Roots
are found by doubling: forms have at least twice their word's count, so paths are short and have no cycle.

Defined cases: null texts have no words, and a null doc_id counts as an empty one; repeated rows count each time; very long texts are read whole, a
slice at a time; ties of the count go to the least form by code points; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import reliable_checkpoint, slices

#: The least length of a word in code points and the least count of one.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run of this many loses a code point.
DAMAGED = 97
#: Entries of a dictionary in a shard, on average, and the most that one half may bring to it.
SHARD = 20_000
#: Distinct words that a task holds before it sends their counts.
MOST_COUNTS = 300_000
RUN = re.compile("[a-zÀ-ÿ]+")


def damaged(run: str, h: int) -> str:
    """The run, without one code point if its hash says so."""
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: the words of all texts and how often they occur."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("text", "doc_id")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            words = list(found)
            for lo in range(0, len(words), 50_000):
                part = words[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[w] for w in part], pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in slices(whole, 0):
                for text, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    begun = zlib.crc32(doc_id + b":")
                    # bytes.lower() changes A-Z only; what is no UTF-8 is between runs.
                    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                        h = zlib.crc32(run.encode(), begun)
                        word = run if h % DAMAGED else damaged(run, h)
                        if len(word) >= least_length:
                            found[word] += n
                    if len(found) >= MOST_COUNTS:
                        yield from told()
                        found.clear()
        yield from told()

    counted = docs.select(*own).mapInArrow(scan, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of some distinct sorted words.

    A state is a tuple (number of words it leads to, whether a word ends here, its edges): edges map a code
    point to the next state and to how many words of this state come before those of the edge.
    """

    def __init__(self, words: list[str]):
        self.known: dict[tuple, tuple] = {}
        # What the path of the last word has gathered at each depth: whether a word ends there, and edges so far.
        ends, edges, path = [False], [[]], ""
        for word in words:
            same, most = 0, min(len(word), len(path))
            while same < most and word[same] == path[same]:
                same += 1
            self._close(ends, edges, path, same)
            for _ in word[same:]:
                ends.append(False)
                edges.append([])
            ends[-1] = True
            path = word
        self._close(ends, edges, path, 0)
        self.start = self._state(ends[0], edges[0])

    def _close(self, ends: list[bool], edges: list[list], path: str, depth: int) -> None:
        """States below a depth are complete: equal ones become one."""
        for k in range(len(path), depth, -1):
            edges[k - 1].append((path[k - 1], self._state(ends.pop(), edges.pop())))

    def _state(self, end: bool, edges: list[tuple[str, tuple]]) -> tuple:
        key = (end, tuple((c, id(s)) for c, s in edges))
        found = self.known.get(key)
        if found is None:
            n, out = int(end), {}
            for c, s in edges:
                out[c] = (s, n)
                n += s[0]
            found = self.known[key] = (n, end, out)
        return found

    def number(self, word: str) -> int | None:
        """The word's place in sorted order; None for what is no word."""
        state, n = self.start, 0
        for c in word:
            step = state[2].get(c)
            if step is None:
                return None
            state, n = step[0], n + step[1]
        return n if state[1] else None

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with ``word[:half]`` and are exactly one error from ``word``, made after that half."""
        state, n = self.start, 0
        for c in word[:half]:
            step = state[2].get(c)
            if step is None:
                return set()
            state, n = step[0], n + step[1]
        found, last = set(), len(word)

        def complete(state: tuple, n: int, at: int) -> None:
            while at < last:
                step = state[2].get(word[at])
                if step is None:
                    return
                state, n, at = step[0], n + step[1], at + 1
            if state[1]:
                found.add(n)

        for at in range(half, last + 1):
            c = word[at] if at < last else None
            if c is not None:
                complete(state, n, at + 1)
            for other, (after, before) in state[2].items():
                if other != c:
                    complete(after, n + before, at)
                    if c is not None:
                        complete(after, n + before, at + 1)
            if c is None or c not in state[2]:
                break
            step = state[2][c]
            state, n = step[0], n + step[1]
        return found


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, near and near_n: every pair of words (``words``: word, n; one row a word) that are one error apart, from either side."""
    m = F.length("word")
    sides = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    # A word read in its direction; a half is the exact part of a question in that reading.
    read = words.select("word", "n", sides).withColumn("read", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    half = lambda length: F.when(F.col("back"), length - F.floor(length / 2)).otherwise(F.floor(length / 2)).cast("int")
    questions = read.select("back", "read", half(m).alias("half")).withColumn("key", F.expr("substring(read, 1, half)"))
    asked = F.explode(F.array_distinct(F.array(half(m - 1), half(m), half(m + 1)))).alias("half")
    entries = read.select("back", "read", "n", asked).where(F.length("read") >= F.col("half")).withColumn("key", F.expr("substring(read, 1, half)"))
    sizes = entries.groupBy("back", "half", "key").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > shard).select("back", "half", "key", F.ceil(F.col("size") / F.lit(shard)).cast("int").alias("parts"))
    large = reliable_checkpoint(large)
    n_entries = words.count() * 4
    shards = max(1, n_entries // shard)
    # At most n_entries / shard keys are large; beyond some thousands they are joined, not sent to all.
    told = F.broadcast(large) if shards <= 50_000 else large
    if large.isEmpty():
        questions, entries = questions.withColumn("part", F.lit(0)), entries.withColumn("part", F.lit(0))
    else:
        keys = ["back", "half", "key"]
        questions = questions.join(told, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        entries = entries.join(told, keys, "left").withColumn("part", F.pmod(F.xxhash64("read"), F.coalesce("parts", F.lit(1))).cast("int"))
    place = F.pmod(F.xxhash64("back", "half", "key", "part"), F.lit(shards)).cast("int").alias("shard")
    asks, held = questions.select(place, "back", "read", "half").toDF("shard", "back", "read", "half"), entries.select(place, "back", "read", "n").toDF("shard", "back", "read", "n")

    def search(key: tuple, ask: pa.Table, hold: pa.Table) -> pa.Table:
        back = key[1].as_py()
        counts = dict(zip(hold.column("read").to_pylist(), hold.column("n").to_pylist(), strict=True))
        texts = sorted(counts)
        automaton, own, near = Automaton(texts), [], []
        for word, half in zip(ask.column("read").to_pylist(), ask.column("half").to_pylist(), strict=True):
            kept = len(word) - half
            for k in automaton.near(word, half):
                other = texts[k]
                # The first half of a word read from its end is its last part; that pair is the forward walk's.
                if back and len(other) >= kept and other[len(other) - kept :] == word[half:]:
                    continue
                own.append(word[::-1] if back else word)
                near.append(k)
        numbers = [counts[t] for t in texts]
        return pa.table({"word": pa.array(own, pa.string()), "near": pa.array([texts[k][::-1] if back else texts[k] for k in near], pa.string()), "near_n": pa.array([numbers[k] for k in near], pa.int64())})

    return asks.groupBy("shard", "back").cogroup(held.groupBy("shard", "back")).applyInArrow(search, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last form on each word's path (``forms``: word, form), by doubling."""
    held = reliable_checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        then = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = reliable_checkpoint(held.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        held = step.select("word", "root")
        if step.where("moved").isEmpty():
            return held


def variants(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n, form, root, n_near and form_n of every word."""
    words = reliable_checkpoint(word_counts(docs))
    links = near_words(words, shard).groupBy("word").agg(F.collect_set(F.struct("near_n", "near")).alias("near"))
    # The largest count first, then the least code points; both are compared as one row.
    best = F.array_min(F.transform("near", lambda x: F.struct((-x["near_n"]).alias("less"), x["near"].alias("form"))))
    found = words.join(links.select("word", F.size("near").cast("bigint").alias("n_near"), best.alias("best")), "word", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    told = reliable_checkpoint(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
