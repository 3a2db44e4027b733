"""Source divergence audit: how far the term shares of each source lie from those of other sources.

Texts are broken into terms, counted by language, source and term, and the terms that a language has in at
least ``LEAST_DOCS`` documents are kept. A group (a source of a language, or the whole language) gives each kept
term the share p of 10 ** 9 in whole numbers, smoothed by one, and what a term adds to the distance of two
shares is floor((p - q) * (p - q) / q). Every source is compared with every other source of its language
(sums over all kept terms) and, term by term, with its language.

The sums are split by how many sources a term occurs in. Terms of more than ``LIGHT`` sources are
dense: a task has a tile of terms of one language as a numpy matrix (terms x sources, with the share of a count of zero
where a source has none) and adds all pairs of its columns. Rare terms are never laid out: if no source
had them, each pair would get the same amount for each; for a source that has some, the amount against a zero depends only
on its share, so terms of equal share are counted together (one row a share, not one a term); and
only for pairs of sources in one posting list, at most ``LIGHT * (LIGHT - 1)`` a term, is that corrected
to the amount of both shares. All parts are whole numbers, and their sum is exact.

Scale: texts are counted in slices, the counts of each are shuffled by term with partial sums, and no
language, source or term is gathered in one task: tiles are cut by ``TILE`` cells and by ``BLOCK`` rows of pairs. Sums of
pairs have the result's own size, sources squared. Totals of sources are broadcast up to ``MOST_TOTALS`` rows and joined beyond.

Defined cases: null text, lang and source count as empty strings; a group without terms counts, with the share of
zero for each kept term; a language without kept terms gives pairs of value 0; a lone source has no pairs; ties
are ranked by the item's bytes; repeated rows are documents of their own; very long texts are counted whole, a
slice at a time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymark.llm.common import reliable_checkpoint, slices

SCALE = 1_000_000_000
LEAST_DOCS = 3
#: Ranks of the part ``term``.
MOST_TERMS = 200
#: A term of at most this many sources is rare.
LIGHT = 8
#: Cells of a dense tile.
TILE = 1 << 19
#: Sources whose pairs one task adds.
BLOCK = 256
#: Distinct counts that a task holds before it sends them.
MOST_COUNTS = 300_000
#: Totals of sources are broadcast up to this many rows, of about 100 bytes.
MOST_TOTALS = 50_000
# In UTF-8, every byte from 80 belongs to a character beyond the excluded ranges.
TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents), summed; a null term stands for the group itself."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("text", "lang", "source")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, bytes], dict[bytes | None, list[int]]] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            rows = [(lang, source, t, n, d) for (lang, source), terms in found.items() for t, (n, d) in terms.items()]
            for lo in range(0, len(rows), 50_000):
                columns = list(zip(*rows[lo : lo + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns[:3]] + [pa.array(c, pa.int64()) for c in columns[3:]], names=["lang", "source", "term", "n", "docs"])

        for whole in batches:
            for batch in slices(whole, 0):
                for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    terms = found.get((lang, source))
                    if terms is None:
                        terms = found[lang, source] = {None: [0, 0]}
                        held += 1
                    terms[None][1] += 1
                    for t, n in Counter(TERM.findall(text.lower())).items():
                        sums = terms.get(t)
                        if sums is None:
                            terms[t] = [n, 1]
                            held += 1
                        else:
                            sums[0] += n
                            sums[1] += 1
                    if held >= MOST_COUNTS:
                        yield from told()
                        found.clear()
                        held = 0
        yield from told()

    counted = docs.select(*own).mapInArrow(scan, "lang binary, source binary, term binary, n bigint, docs bigint")
    # What leaves a task is summed already; dealt by term, it is summed by source and by language without another shuffle.
    dealt = counted.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs").repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10 ** 9 * (count + 1) / whole), three digits at a time, so that no product leaves 64 bits."""
    high, rest = F.call_function("div", count + 1, whole), (count + 1) % whole
    for _ in range(3):
        high, rest = high * 1000 + F.call_function("div", rest * 1000, whole), (rest * 1000) % whole
    return high + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def apart_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Counts:
    """Counts of kept terms, and totals of sources and languages."""

    def __init__(self, docs: DataFrame):
        of_term = Window.partitionBy("lang", "term")
        counts = term_counts(docs).select("lang", "source", "term", "n", *[f(c).over(of_term).alias(name) for f, c, name in ((F.sum, "n", "lang_n"), (F.sum, "docs", "in_docs"), (F.count, "n", "in_sources"))])
        kept = reliable_checkpoint(counts.where((F.col("in_docs") >= LEAST_DOCS) | F.col("term").isNull()).drop("in_docs"))
        self.terms, groups = kept.where("term IS NOT NULL"), kept.where("term IS NULL").select("lang", "source")
        sums = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        # A term of k sources has k rows.
        sizes = self.terms.groupBy("lang", "in_sources").agg(F.sum("n").alias("n"), (F.count(F.lit(1)) / F.col("in_sources")).cast("bigint").alias("terms"))
        whole = sizes.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("terms").alias("v"), F.sum(F.when(F.col("in_sources") <= LIGHT, F.col("terms")).otherwise(0)).alias("light"))
        numbered = groups.join(sums, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "lang_total", "v", "light"])
        size = F.greatest(F.col("total") + F.col("v"), F.lit(1).cast("bigint"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        #: lang, source, at (its number in the language), total, lang_total, v, light, p0 (the share of a count of zero).
        self.groups = reliable_checkpoint(numbered.withColumn("at", place).withColumn("p0", share(F.lit(0).cast("bigint"), size)))
        self.n_groups = self.groups.count()

    def totals(self, *columns: str | Column) -> DataFrame:
        """Columns of the groups, broadcast if they are few."""
        found = self.groups.select(*columns)
        return F.broadcast(found) if self.n_groups <= MOST_TOTALS else found

    def shares(self) -> DataFrame:
        """Each kept term of a source with the source's number and share, and the language's share."""
        told = self.terms.join(self.totals("lang", "source", "at", "total", "lang_total", "v", "p0"), ["lang", "source"])
        return told.withColumn("p", share(F.col("n"), F.col("total") + F.col("v"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total") + F.col("v")))


def base(counts: Counts) -> DataFrame:
    """Every pair of sources of a language, as if no source had any rare term."""
    g, h = counts.groups.select("lang", F.col("at").alias("g"), F.col("p0").alias("p"), "light"), counts.totals("lang", F.col("at").alias("h"), F.col("p0").alias("q"))
    return g.join(h, "lang").where("g <> h").select("lang", "g", "h", (F.col("light") * apart(F.col("p"), F.col("q"))).alias("value"))


def lone(counts: Counts, shares: DataFrame) -> DataFrame:
    """What a source's rare terms add against sources that have none of them: shares that are equal are counted together."""
    alike = shares.where(F.col("in_sources") <= LIGHT).groupBy("lang", "at", "p0", "p").agg(F.count(F.lit(1)).alias("times"))
    other = counts.totals("lang", F.col("at").alias("other"), F.col("p0").alias("o"))
    p, p0, o = F.col("p"), F.col("p0"), F.col("o")
    sides = F.array(
        F.struct(F.col("at").alias("g"), F.col("other").alias("h"), (apart(p, o) - apart(p0, o)).alias("d")),
        F.struct(F.col("other").alias("g"), F.col("at").alias("h"), (apart(o, p) - apart(o, p0)).alias("d")),
    )
    found = alike.join(other, "lang").where("at <> other").select("lang", "times", F.explode(sides).alias("s"))
    return found.groupBy("lang", "s.g", "s.h").agg(F.sum(F.col("times") * F.col("s.d")).alias("value"))


def corrections(shares: DataFrame) -> DataFrame:
    """For pairs of sources that have the same rare term: the amount of both shares instead of those against zero."""
    lists = shares.where((F.col("in_sources") <= LIGHT) & (F.col("in_sources") > 1)).groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "p0")).alias("l"))

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            starts = column.offsets.to_numpy().astype(np.int64)
            own = column.values
            at, p, p0 = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            lengths = np.diff(starts)
            # Each entry beside every other of its list: shifted by 1, 2, ... places, around the list's end.
            inside = np.repeat(np.arange(batch.num_rows), lengths)
            first, size, where = np.repeat(starts[:-1], lengths), np.repeat(lengths, lengths), np.arange(starts[0], starts[0] + lengths.sum())
            langs, parts = batch.column(0).dictionary_encode(), []
            code = langs.indices.to_numpy(zero_copy_only=False)[inside].astype(np.int64)
            for shift in range(1, int(lengths.max(initial=0))):
                fits = size > shift
                i = where[fits]
                j = first[fits] + (i - first[fits] + shift) % size[fits]
                value = apart_of(p[i], p[j]) - apart_of(p[i], p0[j]) - apart_of(p0[i], p[j]) + apart_of(p0[i], p0[j])
                parts.append((code[fits], at[i], at[j], value))
            if not parts:
                continue
            code, g, h, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((h, g, code))
            code, g, h, value = code[order], g[order], h[order], value[order]
            new = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(g) != 0) | (np.diff(h) != 0)])
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(code[new])), pa.array(g[new]), pa.array(h[new]), pa.array(np.add.reduceat(value, new))], names=["lang", "g", "h", "value"])

    return lists.select("lang", "l").mapInArrow(correct, "lang string, g bigint, h bigint, value bigint")


def dense(counts: Counts, shares: DataFrame) -> DataFrame:
    """Sums of the terms of many sources: tiles of terms as matrices, a block of sources against all sources."""
    heavy = shares.where(F.col("in_sources") > LIGHT).select("lang", "term", "at", "p")
    sizes = counts.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.first("v").alias("v"), F.first("light").alias("light"))
    cut = sizes.select(
        "lang", F.ceil((F.col("v") - F.col("light")) * F.col("sources") / F.lit(TILE)).cast("int").alias("tiles"), F.ceil(F.col("sources") / F.lit(BLOCK)).cast("int").alias("blocks")
    ).where("tiles > 0")
    cut = F.broadcast(cut) if counts.n_groups <= MOST_TOTALS else cut
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    rows = heavy.join(cut, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile"), every, "term", "at", "p")
    zeros = counts.groups.select("lang", "at", "p0").join(cut, "lang").select("lang", "at", "p0", "blocks", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    zeros = zeros.select("lang", "tile", every, "at", "p0").toDF("lang", "tile", "block", "at", "p0")

    def add(key: tuple, own: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, block = (k.as_py() for k in key)
        kinds = {"lang": pa.string(), "g": pa.int64(), "h": pa.int64(), "value": pa.int64()}
        if not own.num_rows:
            return pa.table({k: pa.array([], kind) for k, kind in kinds.items()})
        p0 = np.zeros(groups.num_rows, np.int64)
        p0[groups.column("at").to_numpy()] = groups.column("p0").to_numpy()
        terms = own.column("term").combine_chunks().dictionary_encode()
        matrix = np.tile(p0, (len(terms.dictionary), 1))
        matrix[terms.indices.to_numpy(), own.column("at").to_numpy()] = own.column("p").to_numpy()
        columns = np.ascontiguousarray(matrix.T)
        g = np.arange(block * BLOCK, min((block + 1) * BLOCK, len(p0)))
        sums = np.stack([apart_of(columns[k], columns).sum(axis=1) for k in g])
        return pa.table({"lang": pa.array([lang] * sums.size), "g": np.repeat(g, len(p0)), "h": np.tile(np.arange(len(p0)), len(g)), "value": sums.ravel()})

    keys = ["lang", "tile", "block"]
    return rows.groupBy(*keys).cogroup(zeros.groupBy(*keys)).applyInArrow(add, "lang string, g bigint, h bigint, value bigint").where("g <> h")


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: the distances of sources, and the terms that set a source apart."""
    counts = Counts(docs)
    shares = counts.shares().select("lang", "source", "at", "term", "in_sources", "p", "q", "p0")
    parts = [base(counts), lone(counts, shares), corrections(shares), dense(counts, shares)]
    whole = parts[0].selectExpr("lang", "CAST(g AS BIGINT) AS g", "CAST(h AS BIGINT) AS h", "value")
    for part in parts[1:]:
        whole = whole.unionByName(part.selectExpr("lang", "CAST(g AS BIGINT) AS g", "CAST(h AS BIGINT) AS h", "value"))
    sums = whole.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    pairs = sums.join(counts.totals("lang", F.col("at").alias("g"), "source"), ["lang", "g"]).join(counts.totals("lang", F.col("at").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    terms = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= MOST_TERMS))


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
s AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(tot.total, 0) + v.v) AS p,
             1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.total + v.v) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
      LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
                    FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
         ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM s WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 200"""
