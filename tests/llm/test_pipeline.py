import random

import pytest

pytest.importorskip("quaymark.llm")
import corpus_pipeline
from quaymark.llm import language_crf, near_copies, quality_classifier, simhash

WORDS = {"en": "the and of that with this from which would there thing school people water house".split(), "de": "der die und nicht eine werden schule straße wasser haus leute können ungefähr durch".split()}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("corpus")
    rows, marks = [], []
    for k in range(300):
        lang, bad = ("en", "de")[k % 2], k % 6 == 0
        text = " ".join("".join([rng.choice(WORDS[lang]), rng.choice(["", "", rng.choice(WORDS[lang])])]) + ("$$$" if bad else "") for _ in range(120))
        rows.append((k, text, lang, "s", len(text)))
        marks.append((k, int(not bad), 0))
    shared = " ".join(rng.choice(WORDS["en"]) + str(rng.randrange(99)) for _ in range(60))
    rows += [(300, rows[1][1], "de", "s", 5), (301, rows[1][1] + " haus", "de", "s", 5), (302, None, None, "s", 0), (303, "12345 67", "en", "s", 8)]
    rows += [(310 + k, " ".join(rng.choice(WORDS["en"]) for _ in range(100)) + " " + shared, "en", "s", 1) for k in range(2)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


def stage(spark, docs, folder, number, path):
    corpus_pipeline.STAGES[number][1](spark, docs, folder).write.parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, corpus, tmp_path):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = stage(spark, docs, folder, 0, str(tmp_path / "0"))
    model = quality_classifier.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {k for k, t in texts.items() if model.score(quality_classifier.features((t or "").encode())) >= 0.3}
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(kept) == good and kept.columns == columns and good >= {k for k in range(300) if k % 6} and not good & {k for k in range(300) if k % 6 == 0}
    spoken = stage(spark, kept, folder, 1, str(tmp_path / "1"))
    assert ids(spoken) == {r.doc_id for r in language_crf.identify(kept, language_crf.train(kept)).collect() if r.lang_pred != "und" and r.score >= 0.5} and not ids(spoken) & {302, 303}
    single = stage(spark, spoken, folder, 2, str(tmp_path / "2"))
    prints = {k: simhash.fingerprint(texts[k].encode()) for k in ids(spoken)}
    groups = {k: min(j for j in prints if (prints[j] ^ prints[k]).bit_count() <= 2) for k in prints}
    while (more := {k: groups[g] for k, g in groups.items()}) != groups:
        groups = more
    assert ids(single) == set(groups.values()) and 1 in ids(single) and 300 not in ids(single)
    cut = stage(spark, single, folder, 3, str(tmp_path / "3"))
    left = {r.doc_id: r for r in cut.collect()}
    assert set(left) == ids(single) and cut.columns == columns and all(r.n_chars == len(r.text) for r in left.values())
    assert all(len(left[k].text) < 700 for k in (310, 311) if k in left) and left[1].text == texts[1]
    packed = stage(spark, cut, folder, 4, str(tmp_path / "4"))
    assert ids(packed) == set(left)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id").collect())) == sorted(map(tuple, packed.drop("sequence_id").collect()))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def near(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return corpus_pipeline.STAGES[2][1](spark, docs, "").collect()


def test_near_duplicates_at_four_fifths(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
    swapped = lambda n: [f"x{k}" if k % 9 == 0 and k < 9 * n else w for k, w in enumerate(base)]
    rows = [(k, " ".join(swapped(n))) for k, n in enumerate((0, 5, 6))]
    sets = [near_copies.shingles(t.encode()) for _, t in rows]
    assert near_copies.similar(sets[0], sets[1]) and not near_copies.similar(sets[0], sets[2])
    assert {r.doc_id for r in near(spark, rows[:2])} == {0} and {r.doc_id for r in near(spark, [rows[0], rows[2]])} == {0, 2}
    # A chain whose ends are far apart is one group; many unrelated texts stay.
    chain = [(100 + k, " ".join(base[8 * k : 8 * k + 140])) for k in range(8)]
    others = [(200 + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40)))) for k in range(50)]
    assert not near_copies.similar(*(near_copies.shingles(chain[k][1].encode()) for k in (0, 7)))
    assert {r.doc_id for r in near(spark, chain + others)} == {100} | {k for k, _ in others}


def test_near_duplicates_keep_a_row_of_each_group(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    kept = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in near(spark, rows))
    assert kept([(None, a), (None, b), (None, a), (3, c), (None, c)]) == sorted([(True, 0, a), (True, 0, b), (False, 3, c)])
    assert kept([(5, a), (5, b), (1, b), (5, d), (5, d)]) == sorted([(False, 5, a), (False, 1, b), (False, 5, d)])
    assert kept([(None, a), (None, a + " end")]) in ([(True, 0, a)], [(True, 0, a + " end")])


def test_near_duplicates_equal_a_search_of_all_pairs(spark, monkeypatch):
    """A large group of edited copies without their original, of which some are similar to none, and chains."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, base = [], [word() for _ in range(150)]
    for k in range(120):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 3, 4, 4, 5])):
            own[at] = word()
        rows.append((k, " ".join(own[rng.randrange(3) :])))
    rows += [(200 + k, " ".join(word() for _ in range(rng.randrange(1, 60)))) for k in range(20)] + [(300, rows[3][1]), (301, rows[4][1].upper())]
    sets = [near_copies.shingles(near_copies.joined_words(t.encode())) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if near_copies.similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (name, _) in enumerate(rows):
        least[find(k)] = min(name, least.get(find(k), name))
    assert 20 < len(least) < 120
    for block in (near_copies.BLOCK_SHINGLES, 2000):
        monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", block)
        assert {r.doc_id for r in near(spark, rows)} == set(least.values())
