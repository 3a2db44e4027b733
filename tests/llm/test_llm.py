import itertools
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("quaymark.llm")
import public_tokenizers
from pyspark.sql import functions as F

from quaymark.llm import common, gif, language_crf, packing, quality_classifier, quality_rules, revisits, sampled_pieces, simhash, suffix_dedup, toxicity

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, chunk int, bits int, words string, kept string, predicted string"
LONG = "lorem ipsum " * 6000
ODD = [
    (1, "The cat and the dog sat on the mat. It was fine.\nThe cat and the dog sat on the mat. It was fine.", "en"),
    (2, None, None), (3, "", "en"), (4, "   \n\t ", "fr"), (5, LONG, "en"), (6, "x", "de"), (6, "x", "de"), (None, "the end of it all and more", "en"), (8, "né à l'été, où ça 日本 🎉 \x00 ﬁ", "fr"), (9, "y" * 900, None),
]


def table(spark, rows=ODD):
    return spark.createDataFrame([(k, t, lang, "s", len(t or ""), 0.5, 1, 2, "w", "k", "p") for k, t, lang in rows], SCHEMA)


def labels(spark, rows=((1, 1, 0), (3, 0, 0), (5, 0, 1), (8, 1, 0), (9, None, None))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


DIGESTS = {
    "packing": lambda d, _: packing.packing_digest(d, BPE),
    "toxicity": toxicity.toxicity_digest,
    "language": lambda d, _: language_crf.language_digest(d),
    "pieces": lambda d, _: sampled_pieces.sampled_digest(d, PIECES),
    "suffixes": lambda d, _: suffix_dedup.repeats_digest(d),
    "simhash": lambda d, _: simhash.near_duplicates_digest(d),
    "gif": lambda d, _: gif.media_digest(d),
    "rules": lambda d, _: quality_rules.rules_digest(d),
    "quality": quality_classifier.quality_digest,
}


@pytest.mark.parametrize("name", DIGESTS)
def test_odd_rows_and_empty_tables(spark, name):
    docs = table(spark)
    found = DIGESTS[name](docs, labels(spark)).collect()
    ids = Counter(r.doc_id for r in found)
    if name == "packing":
        assert set(ids) == {k for k, _, _ in ODD}
    else:
        assert ids == Counter(k for k, _, _ in ODD)
        twins = [r for r in found if r.doc_id == 6]
        assert twins[0] == twins[1]
    assert DIGESTS[name](docs.limit(0), labels(spark).limit(0)).collect() == []
    assert len(DIGESTS[name](docs, labels(spark).limit(0)).collect()) == len(found)


# Packing ------------------------------------------------------------------------------------------


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Été", "it's", "<|endoftext|>", "№5", "a\x85b", "don't!!"]) for _ in range(n)) for n in (0, 1, 7, 4095, 9000)]
    pieces = packing.pack_documents(table(spark, [(k, t, "en") for k, t in enumerate(texts)]), BPE).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    by = defaultdict(list)
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and p.length <= 4096 and p.offset == 0 and p.bucket == p.length.bit_length() - 1
        by[p.doc_id].append(p)
    for k, text in enumerate(texts):
        own = sorted(by[k], key=lambda p: p.start)
        ids = b"".join(p.ids for p in own)
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert [p.start for p in own] == [0, *itertools.accumulate(p.length for p in own)][:-1]


def test_other_tokenizers_are_used_as_they_are(tmp_path):
    import json

    from tokenizers import Tokenizer

    layout = json.load(open(BPE, encoding="utf-8"))
    layout["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(layout))
    text = "Some THING's here\n  and There"
    own = Tokenizer.from_file(str(tmp_path / "t.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordEncoder(str(tmp_path / "t.json")).encode(text.encode()), "<u4").tolist() == own != np.frombuffer(packing.WordEncoder(BPE).encode(text.encode()), "<u4").tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12345])
def test_piece_lengths(n):
    found = packing.piece_lengths(n, 4096)
    assert sum(found) == n and len([x for x in found if x < 4096]) == bin(n % 4096).count("1")


def test_buckets_are_folders(spark, tmp_path):
    packing.write_buckets(packing.pack_documents(table(spark), BPE), str(tmp_path / "b"))
    assert {r.length for r in spark.read.parquet(str(tmp_path / "b")).where("bucket = 3").collect()} <= {8}


# Toxicity -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw,plain", [("Іdiоt!", "idiot"), ("1d10t", "idiot"), ("M0R0N,", "moron"), ("tra​sh", "trash"), ("ｓｃｕｍ", "scum"), ("pa$$ing", "passing"), ("été", "été"), ("$tupid", "stupid"), ("@ss", "ass"), ("stu\u0308pid", "stüpid"), ("x\u0336y\u0336", "xy"), ("oﬃce", "office")])
def test_folding(raw, plain):
    assert toxicity.fold(f"an {raw} x").split() == ["an", plain, "x"]


def test_exceptions_and_length():
    model = toxicity.Model({" trash ": 3.0, " lowei": 2.0}, frozenset({"trash can"}), (1.0, 1.0, -3.0))
    spans = lambda t: [w for _, _, w in model.matches(toxicity.fold(t))]
    assert spans("trash can, trash cans; a loweiend trashy") == [3.0, 2.0]
    assert spans("a trash can") == [] and spans("trash") == [3.0]
    assert model.score("trash") > model.score("trash " + "fine words here " * 50) > model.score("fine") == model.score("trash can")


def test_matches_equal_a_naive_search():
    rng = random.Random(8)
    for _ in range(200):
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
        weights = {rng.choice([f" {word()} ", f" {word()}"]): rng.random() + 0.1 for _ in range(6)}
        exceptions = frozenset(f"{word()} {word()}" for _ in range(4))
        folded = f" {' '.join(word() for _ in range(30))} "
        excused = [(k, k + len(e) + 1) for e in exceptions for k in range(len(folded)) if folded.startswith(f" {e} ", k)]
        best = {}
        for k in range(len(folded)):
            for e, w in weights.items():
                if folded.startswith(e, k) and not any(a <= k < b - 1 for a, b in excused):
                    best[k] = max(best.get(k, 0), w)
        assert {s: w for s, _, w in toxicity.Model(weights, exceptions).matches(folded)} == best


def test_toxicity_of_very_long_texts():
    model = toxicity.Model({" trash ": 3.0}, frozenset({"trash can"}), (1.0, 1.0, -3.0))
    began = time.perf_counter()
    assert model.score("trash can trash " * 330_000) > model.score("fine")
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("rows", [[(7, f"word{k % 900} again", "en") for k in range(5000)] + [(8, "a b", "fr"), (9, "c d", "en")]])
def test_repeated_ids_are_one_labelled_row(spark, rows):
    docs, marks = table(spark, rows), labels(spark, [(k, k % 2, k % 2) for k in (7, 7, 8, 9)])
    known = marks.select("doc_id", F.col("quality").alias("label"))
    found = common.labelled_texts(docs, known, 2).collect()
    assert len(found) == len({r.doc_id for r in found}) == 2
    assert {r.doc_id for r in common.labelled_texts(docs, known, 10).collect()} == {7, 8, 9}
    by_lang = common.labelled_texts(docs, docs.select("doc_id", F.col("lang").alias("label")), 10, F.col("lang")).collect()
    assert sorted((r.doc_id, r.label) for r in by_lang) == [(7, "en"), (8, "fr"), (9, "en")]
    assert len(language_crf.language_digest(docs).collect()) == len(rows)


def test_toxicity_learns(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows, marks = [], []
    for k in range(600):
        bad = k % 4 == 0
        own = [rng.choice(words) for _ in range(30)] + ([f"grub{rng.choice('xyz')}{rng.choice('xyz')}", "nasty"][k // 4 % 2 : k // 4 % 2 + 1] if bad else ["nasty weather"] if k % 40 == 1 else [])
        rng.shuffle(own)
        rows.append((k, " ".join(own), "en"))
        marks.append((k, 1, int(bad)))
    found = toxicity.toxicity_digest(table(spark, rows), labels(spark, marks)).where("held_out").collect()
    assert len(found) > 60 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in found]) > 0.95


# Revisits -----------------------------------------------------------------------------------------


def test_canonical_urls(spark):
    url = lambda u: spark.range(1).select(revisits.canonical_url(F.lit(u)).alias("u")).first().u
    assert url("HTTPS://WWW.Example.com:443/a/b/?utm_source=x&b=2&a=1#f") == url("http://m.example.com/a/b?a=1&b=2") == "example.com/a/b?a=1&b=2"
    assert url("http://e.org") == url("http://e.org/#x") == "e.org" and spark.range(1).select(revisits.canonical_url(F.lit(None).cast("string")).alias("u")).first().u is None


def test_shared_record_ids(spark):
    schema = "record_id bigint, url string, kind string, captured_at bigint, status int, headers map<string,string>, digest string, payload string"
    tag = {"etag": '"1"'}
    data = [(1, "http://a/x", "response", 1, 200, tag, "d", "one"), (1, "http://a/x", "response", 1, 200, tag, "d", "two"), (9, "http://a/x", "revisit", 5, 304, tag, None, None), (9, "http://b/", "revisit", 6, 304, tag, None, None), (None, "http://a/x", "revisit", 7, 304, tag, None, None)]
    found = [[(r.record_id, r.canonical_url, r.outcome, r.payload) for r in revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()] for rows in (data, data[::-1])]
    assert sorted(found[0], key=str) == sorted(found[1], key=str) and len(found[0]) == 3
    assert {x[2] for x in found[0] if x[1] == "a/x"} == {"resolved"} and (9, "b", "unresolved", None) in found[0]


def test_bursts_equal_a_plain_search(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("aaaab"), rng.choice([7, 7, 7, rng.randrange(20)]), rng.random() < 0.3) for k in range(3000)]
    found = {r.record_id: r.found for r in revisits.latest_earlier(spark.createDataFrame(rows, "record_id bigint, key string, captured_at bigint, is_response boolean")).collect()}
    for k, key, at, response in rows[:400]:
        if not response:
            earlier = [(t, i) for i, q, t, full in rows if full and q == key and t < at]
            assert found[k] == (max(earlier)[1] if earlier else None)


def test_resolution(spark):
    schema = "record_id bigint, url string, kind string, captured_at bigint, status int, headers map<string,string>, digest string, payload string, extra int"
    tag = lambda t, **more: {"etag": t, **more}
    data = [
        (1, "http://a/x", "response", 10, 200, tag('"1"', server="s", **{"cache-control": "old"}), "d", "one", 0), (2, "http://a/x", "response", 20, 200, tag('"2"'), "d", "two", 0), (3, "http://a/x", "response", 20, 404, {}, "d", "no", 0),
        (4, "http://a/x", "response", 20, 200, tag('"3"'), "d", "three", 0), (10, "https://a/x/", "revisit", 15, 304, tag('W/"1"', **{"cache-control": "new", "content-length": "0"}), None, None, 0), (11, "http://a/x", "revisit", 20, 304, tag('"1"'), None, None, 0),
        (12, "http://a/x#f", "revisit", 25, 304, tag('"3"'), None, None, 0), (13, "http://a/x", "revisit", 26, 304, tag('"9"'), None, None, 0), (14, "http://a/x", "revisit", 27, 304, {}, None, None, 0), (15, "http://a/x", "revisit", 27, 304, None, "d", None, 0),
        (16, "http://a/x", "revisit", 5, 304, tag('"1"'), None, None, 0), (17, None, "revisit", 30, 304, tag('"1"'), None, None, 0), (18, "http://b", "revisit", None, 304, tag('"1"'), None, None, 0), (12, "http://a/x#f", "revisit", 25, 304, tag('"3"'), None, None, 0),
    ]
    found = revisits.resolve_revisits(spark.createDataFrame(data, schema)).collect()
    assert Counter((r.record_id, r.outcome, r.response_id, r.payload) for r in found) == Counter(
        [(10, "resolved", 1, "one"), (11, "resolved", 1, "one"), (12, "resolved", 4, "three"), (12, "resolved", 4, "three"), (13, "mismatch", 4, None), (14, "unverified", 4, None), (15, "resolved", 4, "three"), (16, "unresolved", None, None), (17, "unresolved", None, None), (18, "unresolved", None, None)]
    )
    merged = next(r.headers for r in found if r.record_id == 10)
    assert merged == {"etag": 'W/"1"', "server": "s", "cache-control": "new"}
    assert revisits.resolve_revisits(spark.createDataFrame(data, schema).limit(0)).collect() == []


def test_responses_that_many_revisits_name_are_dealt_over_copies(spark, monkeypatch):
    monkeypatch.setattr(revisits, "HOT", 7)
    schema = "record_id bigint, url string, kind string, captured_at bigint, status int, headers map<string,string>, digest string, payload string"
    tag = {"etag": '"1"'}
    data = [(1, "http://a/", "response", 1, 200, tag, "d", "one"), (2, "http://b/", "response", 1, 200, tag, "d", "two"), (None, "http://a/", "response", 3, 200, {"etag": '"2"'}, "d", "no name")]
    data += [(100 + k, "http://a/" if k % 5 else "http://b/", "revisit", 10 + k % 9, 304, tag, None, None) for k in range(60)] + [(7, "http://c/", "revisit", 9, 304, tag, None, None)]
    found = revisits.resolve_revisits(spark.createDataFrame(data, schema)).collect()
    assert Counter((r.record_id, r.outcome, r.response_id, r.payload) for r in found) == Counter([(100 + k, "resolved", *((1, "one") if k % 5 else (2, "two"))) for k in range(60)] + [(7, "unresolved", None, None)])


def test_as_of_against_brute_force(spark):
    rng = random.Random(1)
    events = [(k, rng.choice("aaaab"), rng.randrange(500), rng.random() < 0.4) for k in range(3000)]
    found = {r.record_id: r.found for r in revisits.latest_earlier(spark.createDataFrame(events, "record_id bigint, key string, captured_at bigint, is_response boolean")).collect()}
    for k, key, at, response in events:
        if not response:
            earlier = [(t, j) for j, q, t, r in events if r and q == key and t < at]
            assert found[k] == (max(earlier)[1] if earlier else None)


# Language -----------------------------------------------------------------------------------------


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    moves, lengths = np.exp(rng.normal(size=(3, 3))), [4, 3, 1]
    chains = [rng.random((n, 3)) + 0.1 for n in lengths]
    active = np.array([3, 2, 2, 1])
    flat = np.concatenate([np.stack([c[t] for c in chains if len(c) > t]) for t in range(4)])
    found = language_crf.forward_backward(flat, active, moves)
    at = np.concatenate([[0], np.cumsum(active)])
    for k, chain in enumerate(chains):
        want = np.zeros_like(chain)
        for path in itertools.product(range(3), repeat=len(chain)):
            p = np.prod([chain[t][y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in itertools.pairwise(path)])
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose([found[at[t] + k] for t in range(len(chain))], want / want.sum(axis=1, keepdims=True))


def test_code_switched_words():
    de, en = "der die und nicht eine schule werden können ungen straße", "the and not with school would through thing which street"
    rng = random.Random(2)
    text = lambda ws, n: " ".join(rng.choice(ws.split()) for _ in range(n))
    model = language_crf.fit([text(de, 60) for _ in range(30)] + [text(en, 60) for _ in range(30)], ["de"] * 30 + ["en"] * 30, rounds=30)
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]
    words = language_crf.words_of(f"{text(en, 20)} {text(de, 20)}")
    (_, rows), = language_crf.word_marginals(model, [words])
    assert [model.languages[k] for k in rows.argmax(axis=1)] == ["en"] * 20 + ["de"] * 20
    assert np.allclose(rows.sum(axis=1), 1)


# Sampled pieces -----------------------------------------------------------------------------------


def segmentations(model, word):
    if not word:
        yield (), 1.0
    for k in range(1, len(word) + 1):
        if word[:k] in model.edges:
            piece, weight = model.edges[word[:k]]
            for rest, p in segmentations(model, word[k:]):
                yield (piece, *rest), p * weight


def test_samples_follow_the_lattice():
    model = sampled_pieces.lattice(PIECES, 1.0)
    want = dict(segmentations(model, "▁other"))
    n, total = 20_000, sum(want.values())
    found = Counter(tuple(x.tolist()) for x in sampled_pieces.sample(model, [str(k) for k in range(n)], ["other"] * n, 1))
    assert set(found) <= set(want)
    assert max(abs(found[s] / n - p / total) for s, p in want.items()) < 0.015


@pytest.mark.parametrize("few", [0, 10**9])
def test_all_ways_of_a_word_have_their_share(few, monkeypatch):
    """Forward sums by arrays and by stretches give the enumerated probability to the last edge of each way."""
    monkeypatch.setattr(sampled_pieces, "FEW", few)
    model = sampled_pieces.lattice(PIECES, 1.0)
    words = sampled_pieces.Words(model)
    word = int(words.numbers([[" others"]])[0])
    want = dict(segmentations(model, "▁others"))
    total = sum(want.values())

    def ways(at):
        """(pieces, probability) of all walks from state ``at`` to the start, last piece first."""
        if at == 0:
            yield (), 1.0
            return
        state, below = words.base[word] + at - 1, 0.0
        for edge in itertools.count(words.first[state]):
            share = words.shares[edge]
            for rest, p in ways(int(words.starts[edge])):
                yield (*rest, int(words.pieces[edge])), p * (share - below)
            below = share
            if share == 1.0:
                return

    found = dict(ways(7))
    assert set(found) == set(want) and all(abs(found[x] - want[x] / total) < 1e-12 for x in want)


def test_slices_and_stretches_change_nothing(monkeypatch):
    model = sampled_pieces.lattice(PIECES, 1.0)
    texts = [LONG[:20_000], "x" * 3000 + " " + "abé日▁" * 700, "", "one two", " ".join(f"w{k}" for k in range(3000))]
    keys = [str(k) for k in range(len(texts))]
    want = sampled_pieces.sample(model, keys, texts, 9)
    for name, value in {"SLICE": 1000, "GIANT": 500, "STRETCH": 64, "MOST_STATES": 10}.items():
        monkeypatch.setattr(sampled_pieces, name, value)
        found = sampled_pieces.sample(model, keys, texts, 9)
        assert all(len(a) == len(b) and (a == b).all() for a, b in zip(want, found, strict=True)), name


def test_samples_are_lossless_and_reproducible(spark):
    model = sampled_pieces.lattice(PIECES, 1.0)
    texts = ["", " ", "  a  b ", "▁x▁ ▁", "日本語テキスト 🎉", "\n\t a\x00\x01", "a" * 3000, "é" * 60, LONG[:5000]]
    keys = [str(k) for k in range(len(texts))]
    found = sampled_pieces.sample(model, keys, texts, 3)
    assert [sampled_pieces.decode(model, x).decode() for x in found] == texts
    again = [sampled_pieces.sample(model, [k], [t], 3)[0] for k, t in zip(keys, texts, strict=True)]
    assert all((a == b).all() for a, b in zip(found, again, strict=True))
    assert any(len(a) != len(b) or (a != b).any() for a, b in zip(found, sampled_pieces.sample(model, keys, texts, 4), strict=True))
    docs = table(spark)
    sizes = {(r.doc_id, r.n_bytes) for r in sampled_pieces.sampled_digest(docs, PIECES).collect()}
    assert sizes == {(k, len((t or "").encode())) for k, t, _ in ODD}


# Suffix-array dedup -------------------------------------------------------------------------------


def brute_removed(texts):
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                mask[i : i + 200] = b"\x01" * 200
        out.append(mask)
    return out


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    shared = [noise(n) for n in (199, 200, 201, 331, 332, 333, 700, 1500)]
    texts = []
    for _ in range(60):
        parts = [noise(rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            lo = rng.choice([0, 0, rng.randrange(len(s))])
            parts += [s[lo:], noise(rng.randrange(250))]
        texts.append("".join(parts))
    texts += ["z" * 199, "z" * 200, "q" * 201, "ab" * 300, texts[0], "", texts[5] + "!"]
    docs = table(spark, [(k, t, "en") for k, t in enumerate(texts)])
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, carry=("lang",), n_chunks=1 + 4 * seed, n_buckets=1 + 2 * seed).collect()}
    for k, (text, mask) in enumerate(zip(map(str.encode, texts), brute_removed([t.encode() for t in texts]), strict=True)):
        r = found[k]
        assert bytes(r.kept) == bytes(b for b, m in zip(text, mask, strict=True) if not m), k
        assert (r.n_bytes, r.n_removed, r.lang) == (len(text), sum(mask), "en")
        assert r.n_spans == sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))


# SimHash ------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "one", "One two", "a b c", "É A a\x0bb\x85c " * 300, LONG[:900]])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_search_finds_every_link(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(3000)]
    for p in prints[:300]:
        for flips in (1, 2, 2, 3):
            for b in rng.sample(range(64), flips):
                p ^= 1 << b
            prints.append(p)
    base = rng.getrandbits(64)
    prints = sorted(set(prints + [base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]))
    arr = np.array(prints, np.uint64)
    df = spark.createDataFrame([(int(np.int64(np.uint64(p).view(np.int64))),) for p in arr], "bits bigint")
    for size in (64, 100_000):
        simhash.SHARD_SIZE, old = size, simhash.SHARD_SIZE
        try:
            edges = simhash.link_forests(df)
            roots = {r.node: r.root for r in simhash.connected(edges).collect()}
            n_edges = edges.count()
        finally:
            simhash.SHARD_SIZE = old
        forest = simhash.Forest(len(arr))
        for i in range(len(arr)):
            near = np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2)
            forest.link(np.full(len(near), i), near)
        label = [roots.get(int(p), int(p)) for p in arr.view(np.int64)]
        groups = defaultdict(set)
        for k, r in enumerate(forest.root):
            groups[r].add(label[k])
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
        assert n_edges < 40 * len(arr)


def test_shards_that_one_block_cannot_split():
    rng = random.Random(12)
    low, high = 0x12345678, [rng.getrandbits(32) for _ in range(900)]
    high += [h ^ (1 << rng.randrange(32)) for h in high[:200]] + [high[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    prints = np.unique(np.array([h << 32 | low for h in high], np.uint64))
    found = simhash.shard_links(prints, np.arange(len(prints)), np.zeros(0, np.int64), simhash.BLOCKS[0])
    plain = simhash.Forest(len(prints))
    for k in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 2)
        plain.link(np.full(len(near), k), near)
    assert (found.root == plain.root).all()


def test_components_take_the_least_id(spark):
    long = " ".join(f"w{k % 97}x{k % 89}" for k in range(3000))
    rows = [(9, long, "en"), (4, long + " end", "en"), (7, long, "en"), (5, "other words entirely here", "en"), (3, "", "en"), (2, None, "en")]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates_digest(table(spark, rows)).collect()}
    assert found == {9: 4, 7: 4, 4: 4, 5: 5, 3: 2, 2: 2}


# GIF ----------------------------------------------------------------------------------------------


def slow_lzw(stream, size, n):
    clear, out, width, table_, acc, bits, before, following = 1 << size, [], size + 1, {}, 0, 0, None, (1 << size) + 2
    for byte in stream:
        acc |= byte << bits
        bits += 8
        while bits >= width:
            code, acc, bits = acc & ((1 << width) - 1), acc >> width, bits - width
            if code == clear:
                width, table_, following, before = size + 1, {}, clear + 2, None
                continue
            if code == clear + 1:
                return out[:n]
            entry = [code] if code < clear else table_.get(code) or before + before[:1]
            if before is not None and following < 4096:
                table_[following] = before + entry[:1]
                following += 1
                if following == 1 << width and width < 12:
                    width += 1
            out += entry
            before = entry
    return out[:n]


def test_lzw_streams():
    rng = random.Random(0)
    data = [bytes(rng.choice([rng.randrange(1 << s), 0]) for _ in range(n)) if k % 3 else bytes([1]) * n for k, (s, n) in enumerate(itertools.product((2, 3, 8), (1, 2, 300, 20_000)))]
    sizes = [s for s, _ in itertools.product((2, 3, 8), range(4))]
    streams = [gif.compress(d, s) for d, s in zip(data, sizes, strict=True)]
    found, given = gif.decompress(streams, sizes, [len(d) for d in data])
    assert [x.tobytes() for x in found] == data and given.tolist() == [len(d) for d in data]
    assert [bytes(slow_lzw(st, s, len(d))) for st, s, d in zip(streams, sizes, data, strict=True)] == data
    units = gif.compress_units(data[-1][: 576 * 20])
    assert [bytes(slow_lzw(u, 8, 576)) for u in units] == [data[-1][k : k + 576] for k in range(0, 576 * 20, 576)]
    (cut,), given = gif.decompress([streams[-1][:50]], [8], [len(data[-1])])
    assert cut[:20].tobytes() == data[-1][:20] and cut[-1] == 0 and given[0] < len(cut)


def animation(interlaced=False):
    import struct

    def frame(x, y, w, h, pixels, disposal, transparent, local=b""):
        control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), 5, transparent or 0) + b"\x00"
        flags = (0x81 if local else 0) | (0x40 if interlaced else 0)
        stream = gif.compress(bytes(pixels), 2)
        return control + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + local + b"\x02" + bytes([len(stream)]) + stream + b"\x00"

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    loop = b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    return head + loop + frame(0, 0, 2, 2, [1, 1, 1, 1], 1, None) + frame(0, 0, 2, 1, [2, 0], 3, 0) + frame(1, 1, 1, 1, [3], 2, None) + frame(0, 1, 1, 1, [0], 0, None, bytes([9, 9, 9] * 4)) + b"\x3b"


def test_disposal_transparency_and_palettes(spark):
    red, green, blue, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    media = spark.createDataFrame([(1, bytearray(animation())), (2, bytearray(b"no")), (3, bytearray(animation()[:60])), (4, None)], "id bigint, data binary")
    found = gif.decode_frames(media).collect()
    shown = [[tuple(r.rgba[k : k + 4]) for k in range(0, 16, 4)] for r in found if r.id == 1]
    assert shown == [[red] * 4, [green, red, red, red], [red, red, red, blue], [red, red, (9, 9, 9, 255), clear]]
    assert [(r.starts_at_ms, r.delay_ms, sum(r.histogram)) for r in found if r.id == 1] == [(0, 50, 4), (50, 50, 4), (100, 50, 4), (150, 50, 3)]
    assert {r.id for r in found if r.error} == {2, 3, 4}


def test_damaged_files_have_error_rows(spark):
    import struct

    whole = gif.encode(bytes(range(256)) * 9)
    stream = gif.compress(bytes(range(200)), 8)[:40]
    short = b"GIF89a" + struct.pack("<HHBBB", 20, 10, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 20, 10, 0) + b"\x08" + bytes([len(stream)]) + stream + b"\x00\x3b"
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    wide = b"GIF89a" + struct.pack("<HHBBB", 9, 9, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\x01\x00\x00\x3b"
    files = [whole, whole[:1500], short, huge, wide, b"GIF89a", b"", None]
    media = spark.createDataFrame([(k, 0, None if f is None else bytearray(f)) for k, f in enumerate(files)], "doc_id bigint, n_bytes bigint, media binary")
    back = {r.doc_id: r for r in gif.read_back(media, timed=True).collect()}
    assert back[0].payload == bytearray(bytes(range(256)) * 9) and back[0].error is None and [f.starts_at_ms for f in back[0].frames] == [0, 40, 80, 120]
    assert sum(map(sum, (f.histogram for f in back[0].frames))) == sum(back[0].histogram) == 4 * 576
    assert all(back[k].error and back[k].payload is None for k in range(1, len(files)))
    frames = gif.decode_frames(media.selectExpr("doc_id AS id", "media AS data")).collect()
    assert Counter(r.id for r in frames if r.error is None) == {0: 4, 1: 1} and {r.id for r in frames if r.error} == set(range(1, len(files)))
    assert "breaks off" in back[2].error and "65535" in back[3].error and "65535" in back[4].error


def test_interlaced_rows():
    image = gif.Parsed(1, 9)
    image.frames.append(gif.Frame(0, 0, 1, 9, 0, 0, -1, True, np.arange(27, dtype=np.uint8).reshape(9, 3), 8, b""))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    (canvas,) = gif.shown(image, [np.array(order, np.uint8)])
    assert canvas[:, 0, 0].tolist() == [3 * k for k in range(9)]


def test_stored_payloads(spark):
    import hashlib

    for r in gif.media_digest(table(spark)).collect():
        text = next((t or "").encode() for k, t, _ in ODD if k == r.doc_id)
        payload = gif.payload_of(text)
        assert len(payload) % 576 == 0 and len(payload) > 0 and (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])


# Quality ------------------------------------------------------------------------------------------


def test_rules_equal_sql(spark):
    import duckdb

    rng = random.Random(6)
    rows = [(k, t, "en") for k, t, _ in ODD if k not in (6, None)]
    for k in range(200):
        words = [rng.choice(["the", "of", "a", "Word", "###", "LOUD", "it", "der", "x|y"]) for _ in range(rng.randrange(120))]
        rows.append((100 + k, "".join(w + rng.choice([" ", " ", "\n", "\t", "\n- ", "...\n"]) for w in words), "en"))
    docs = table(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    assert Counter(map(tuple, quality_rules.rules_digest(docs).collect())) == Counter(con.sql(quality_rules.rules_sql()).fetchall())


def test_rules_use_no_python(spark):
    plan = quality_rules.rules_digest(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_descent_meets_its_conditions():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(50, 8, replace=False)), rng.normal(size=8)) for _ in range(80)]
    signs = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    w, bias = quality_classifier.descend(rows, signs, cost=0.5, rounds=400)
    objective = lambda w, b: (w @ w + b * b) / 2 + 0.5 * sum(max(0.0, 1 - s * (w[i] @ x + b)) for (i, x), s in zip(rows, signs, strict=True))
    best = objective(w, bias)
    for _ in range(200):
        step = np.zeros_like(w)
        step[:50] = rng.normal(size=50) * 0.01
        assert objective(w + step, bias + rng.normal() * 0.01) >= best - 1e-3


def test_ratios_and_scores_equal_a_plain_version():
    import math

    rng = random.Random(21)
    texts = [" ".join(rng.choice("good fine nice".split() if k % 2 else "bad poor odd".split()) + rng.choice(["", "x", " the"]) for _ in range(8)).encode() for k in range(60)]
    labels = np.array([k % 2 for k in range(60)])
    rows = [np.sort(quality_classifier.features(t)) for t in texts]
    assert all(len(set(r.tolist())) == len(r) for r in rows)
    model = quality_classifier.fit(rows, labels)
    for f in {int(x) for r in rows for x in r}:
        n = [sum(f in r for r, y in zip(rows, labels, strict=True) if y == k) for k in (0, 1)]
        want = 0.0 if n[0] + n[1] <= 1 else math.log((n[1] + 1) / 30) - math.log((n[0] + 1) / 30)
        assert abs(model.ratios[f] - want) < 1e-12
    for r in rows[:10]:
        norm = math.sqrt(sum(float(model.ratios[f]) ** 2 for f in r)) or 1.0
        margin = sum(float(model.weights[f]) * float(model.ratios[f]) for f in r) / norm + model.bias
        assert abs(model.score(r) - 1 / (1 + math.exp(-(model.slope * margin + model.offset)))) < 1e-9
    assert np.mean([(model.score(r) > 0.5) == bool(y) for r, y in zip(rows, labels, strict=True)]) > 0.95


def test_features_are_indicators():
    ids = quality_classifier.features(b"a b a b a b")
    assert len(set(ids.tolist())) == len(ids)
    assert set(quality_classifier.features(b"x y z").tolist()) == set(quality_classifier.features(b"x  y\nz").tolist())


def test_quality_learns(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for k in range(400):
        bad = k % 5 == 0
        rows.append((k, " ".join("".join(rng.choice("abcdef") for _ in range(5)) + ("%%%" if bad else "") for _ in range(40)), "en"))
        marks.append((k, int(not bad), 0))
    found = quality_classifier.quality_digest(table(spark, rows), labels(spark, marks)).where("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 5 != 0) for r in found]) > 0.97


@pytest.mark.parametrize("ids,modulus", [([None, 0, 7, -3], 5), ([1, 2, 10**12], 4)])
def test_held_out_rows(spark, ids, modulus):
    from quaymark.llm.common import id_text_bucket

    found = spark.createDataFrame([(k,) for k in ids], "doc_id bigint").select(id_text_bucket("doc_id", modulus).alias("b")).collect()
    assert [r.b for r in found] == [zlib.crc32(("" if k is None else str(k)).encode()) % modulus for k in ids]


def test_small_gif_files_that_state_many_large_frames_are_read_in_stretches(spark, monkeypatch):
    texts = [bytes([65 + k % 26]) * n for k, n in enumerate([0, 1, 576, 5000, 20_000, 3])]
    whole = [(i.error, [x.tolist() for x in own], [(a, b, c.tolist()) for a, b, c in shown]) for i, own, shown in gif.frames_of([gif.encode(gif.payload_of(t)) for t in texts])]
    seen = []
    real = gif.decompress
    monkeypatch.setattr(gif, "MOST_PIXELS", 1200)
    monkeypatch.setattr(gif, "decompress", lambda streams, sizes, pixels: seen.append(pixels) or real(streams, sizes, pixels))
    parts = [(i.error, [x.tolist() for x in own], [(a, b, c.tolist()) for a, b, c in shown]) for i, own, shown in gif.frames_of([gif.encode(gif.payload_of(t)) for t in texts])]
    assert parts == whole and len(seen) > 5 and all(sum(p) <= 1200 or len(p) == 1 for p in seen)
    monkeypatch.undo()
    docs = table(spark, [(k, t.decode(), "en") for k, t in enumerate(texts)])
    before = sorted(gif.media_digest(docs).collect())
    monkeypatch.setattr(gif, "BATCH_BYTES", 1)
    assert sorted(gif.media_digest(docs).collect()) == before
