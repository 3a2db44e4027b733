"""Exact dedup, source divergence and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("quaymark.llm")
from quaymark.llm import divergence, exact_dedup, variants

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, size int, row int, n int, term string, shard int, winner int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, source, len(t or ""), "d", 1, 2, 3, "t", 4, 5) for k, t, lang, source in rows], SCHEMA)


def lowered(text):
    return (text or "").encode().lower()


# Exact dedup --------------------------------------------------------------------------------------


def plain_dedup(rows):
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[lowered(t)].append(k)
    least = float("-inf")
    found = Counter()
    for t, own in groups.items():
        own.sort(key=lambda k: least if k is None else k)
        for i, k in enumerate(own):
            found[(k, own[-1], len(own), i == len(own) - 1, hashlib.sha256(t).hexdigest())] += 1
    return found


def dedup_rows():
    rows = [(k, ["A b", "a B", "É", "é", None, "", f"own {k}"][k % 7], "en", "s") for k in range(300)]
    rows += [(None, "a b", None, None), (None, None, "en", "s"), (7, "x" * 200_000, "en", "s"), (7, "X" * 200_000, "en", "s"), (900, "same", "en", "s"), (900, "same", "en", "s")]
    return rows + [(1000 + k, "hot", "en", "s") for k in range(200)]


@pytest.mark.parametrize("shard", [5, 20_000])
def test_dedup_equals_a_plain_grouping(spark, shard):
    rows = dedup_rows()
    found = exact_dedup.dedup_digest(table(spark, rows), shard).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == plain_dedup(rows)


def test_dedup_of_nothing_and_of_one_side_only(spark):
    assert exact_dedup.dedup_digest(table(spark, []).limit(0)).collect() == []
    for rows in ([(None, "a", None, None), (None, "A", None, None)], [(5, "a", None, None)]):
        found = exact_dedup.dedup_digest(table(spark, rows)).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == plain_dedup(rows)


def test_dedup_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = exact_dedup.dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20)
    columns = sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(con.sql(exact_dedup.DEDUP_SQL).select(*columns).fetchall())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 30_000])
def test_perfect_hash_is_minimal_and_checks_bytes(n):
    digest = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    sizes, bits, slot = exact_dedup.perfect_hash(digest)
    assert sorted(slot.tolist()) == list(range(n))
    held = digest[np.argsort(slot)] if n else digest
    assert exact_dedup.slots_of(digest, sizes, bits, held).tolist() == slot.tolist()
    # A digest that differs in its last byte only is no member, wherever it falls.
    other = digest.copy()
    other[:, 31] ^= 1
    assert (exact_dedup.slots_of(other, sizes, bits, held) == -1).all()


def test_digests_without_a_place_on_any_level_are_listed(monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEVELS", 1)
    digest = np.random.default_rng(5).integers(0, 256, (500, 32), dtype=np.uint8)
    sizes, bits, slot = exact_dedup.perfect_hash(digest)
    assert len(sizes) == 1 and bits.sum() < 500 and sorted(slot.tolist()) == list(range(500))
    assert exact_dedup.slots_of(digest, sizes, bits, digest[np.argsort(slot)]).tolist() == slot.tolist()


def test_an_index_is_looked_up_and_extended(spark):
    rows = lambda texts: exact_dedup.distinct(exact_dedup.digests(table(spark, [(k, t, "en", "s") for k, t in texts])))
    index = exact_dedup.build_index(rows([(1, "a"), (2, "A"), (3, "b")]), 2)
    found = exact_dedup.look_up(rows([(4, "a"), (5, "c"), (6, "C")]), index, 2)
    assert Counter((r.member, r.size, r.past_size) for r in found.collect()) == Counter([(True, 1, 2), (False, 2, None)])
    assert Counter((r["size"], r.winner.doc_id) for r in exact_dedup.merged(index, found).collect()) == Counter([(3, 4), (2, 6), (1, 3)])


# Source divergence --------------------------------------------------------------------------------


def plain_divergence(rows):
    """The same by its definition, in Python's whole numbers."""
    docs, counts, groups = defaultdict(int), defaultdict(int), set()
    for _, t, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t).decode()))
        for term, n in terms.items():
            docs[group[0], term] += 1
            counts[group, term] += n
    found = set()
    for lang in {g[0] for g in groups}:
        own = sorted(g for g in groups if g[0] == lang)
        kept = [t for (k, t), n in docs.items() if k == lang and n >= 3]
        shares = {g: {t: 1 + 10**9 * (counts[g, t] + 1) // (sum(counts[g, x] for x in kept) + len(kept)) for t in kept} for g in own}
        whole = {t: sum(counts[g, t] for g in own) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for g in own:
            pairs = [(-sum(f(shares[g][t], shares[h][t]) for t in kept), h[1].encode()) for h in own if h != g]
            terms = [(-f(shares[g][t], q[t]), t.encode()) for t in kept if counts[g, t] > 0 and shares[g][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                found |= {(*g, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(ranked)}
    return found


def divergence_rows():
    rng = random.Random(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Straße", "ÉTÉ", "été", "日本", "a\u0085b"]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 60]))), rng.choice(["en", "en", "de", None]), f"s{min(rng.randrange(30), rng.randrange(30))}") for k in range(400)]
    rows += [(k, "hot words repeat wxx, Hot; words1hot", "en", "s1") for k in range(200)]
    return rows + [(1, None, "en", None), (1, None, "en", None), (None, "", "fr", "a"), (2, "one", "fr", "b"), (3, "alone alone", "it", "z"), (3, "alone", "it", "z"), (3, "Alone", "it", "z"), (4, "long " * 50_000, "en", "s2")]


@pytest.mark.parametrize(("light", "tile", "block", "totals"), [(8, 1 << 19, 256, 50_000), (2, 64, 7, 0), (0, 1 << 19, 256, 50_000), (1000, 64, 7, 50_000)])
def test_divergence_equals_its_definition(spark, monkeypatch, light, tile, block, totals):
    for name, value in (("LIGHT", light), ("TILE", tile), ("BLOCK", block), ("MOST_TOTALS", totals), ("MOST_COUNTS", 500)):
        monkeypatch.setattr(divergence, name, value)
    rows = divergence_rows()
    found = divergence.divergence(table(spark, rows).repartition(3)).collect()
    assert Counter((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in found) == Counter(plain_divergence(rows))


def test_divergence_of_nothing(spark):
    assert divergence.divergence(table(spark, []).limit(0)).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    cases = [(n, whole) for whole in (1, 7, 10**9 + 7, 9 * 10**14 + 1) for n in (0, whole // 3, whole - 1)]
    found = spark.createDataFrame(cases, "n bigint, whole bigint").select("n", "whole", divergence.share(divergence.F.col("n"), divergence.F.col("whole")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.whole for r in found)


def test_divergence_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = divergence.divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    columns = sorted(found.columns)
    want = con.sql(divergence.DIVERGENCE_SQL)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(want.select(*columns).fetchall())


# Spelling variants --------------------------------------------------------------------------------


def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for k, t, *_ in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_error(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n[w], form.get(w), root(w), len(near[w]), n[form[w]] if w in form else None) for w in n}


def variant_rows():
    rng = random.Random(12)
    stems = ["colour", "straße", "détente", "aaaaa", "aaaaaa", "abababab", "señora", "kitten", "sitting", "überaus", "letter", "lettre"]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aoeößr") + w[k:], w[:k] + rng.choice("aoeéÿ") + w[k + 1 :]])
        return rng.choice([w, w, w.capitalize()])

    rows = [(k, " ".join(word() for _ in range(40)) + " x2y-1 ÉTÉÉÉ", "en", "s") for k in range(120)]
    rows += [(None, "colour colour Colours", None, None), (1, None, "en", "s"), (2, "", "en", "s"), (3, "kitten " * 30_000, "en", "s")]
    # A path of several forms, and ties of the count.
    for w, count in (("pathaaaa", 1), ("pathaaab", 2), ("pathaabb", 4), ("pathabbb", 8), ("pathbbbb", 16), ("tiesab", 1), ("tiesac", 2), ("tiesad", 2), ("tiesa", 2)):
        rows += [(4000 + k, f"{w} {w} {w}", "en", "s") for k in range(count)]
    return rows


@pytest.mark.parametrize("shard", [2, 40, 20_000])
def test_variants_equal_a_comparison_of_all_words(spark, shard):
    rows = variant_rows()
    found = variants.variants(table(spark, rows).repartition(3), shard).collect()
    want = plain_variants(rows)
    assert Counter((r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in found) == Counter(want)
    assert any(r[3] not in (r[0], r[2]) for r in want)


def test_variants_of_the_given_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    found = variants.variants(table(spark, rows)).collect()
    assert Counter((r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in found) == Counter(plain_variants(rows))


def test_variants_of_nothing(spark):
    assert variants.variants(table(spark, []).limit(0)).collect() == []
    assert variants.variants(table(spark, [(1, "short", "en", "s")])).collect() == []


def test_automaton_numbers_its_words_in_order():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abç", k=rng.randrange(0, 7))) for _ in range(500)})
    automaton = variants.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("zz") is None and automaton.number(words[-1] + "a") is None
    ends = {tuple(sorted(w[k:] for w in words if w.startswith(p))) for w in words for k, p in ((k, w[:k]) for k in range(len(w) + 1))}
    assert len(automaton.known) == len(ends)
    assert variants.Automaton([]).near("abc", 1) == set()
