"""Path rules and names as tables, against plain loops."""

import fnmatch
import random

from pyspark.sql import functions as F

from quaymark.operators import inventory, path_rules

GLOBS = ["*", "/a/*", "/a/?", "GET /b*", "/[ab]/x", "/[!ab]/x", "/a.b+(c)", "/é/*", "", "[", "/a[", "/[]]x", "/{}/*", "/x\\y", "/" + "l" * 80 + "*", "/a\nb*", "[[]a", "/[a^]z", "/[^a]z"]
PATHS = ["/a/x", "/b/x", "/c/x", "/a.b+(c)", "/aXb+(c)", "/é/ö", "", "[", "/a[", "/]x", "/{id}/q", "/x\\y", "/" + "l" * 80 + "m", "/" + "l" * 79, "/a\nbc", "[a", "/^z", "/az", "/bz"]


def test_globs_match_as_a_loop_does(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(PATHS)] + [(99, None)], "k int, v string")
    globs = spark.createDataFrame([(g,) for g in GLOBS] + [(None,)], "glob string")
    found = {(r.k, r.glob) for r in path_rules.matching_globs(rows, "k", "v", globs, "glob").collect()}
    assert found == {(k, g) for k, p in enumerate(PATHS) for g in GLOBS if fnmatch.fnmatchcase(p, g)}
    assert path_rules.matching_globs(rows, "k", "v", globs.limit(0), "glob").collect() == []


def test_scopes_by_rules(spark):
    rows = spark.createDataFrame([("e1", "GET", "/a/{x}"), ("e2", "POST", "/a/{y}"), ("e3", "GET", "/b")], "id string, method string, path string")
    rules = lambda *r: spark.createDataFrame(list(r), "kind string, glob string")
    told = lambda r: {x.id for x in path_rules.scopes(rows, "id", r).where("scope = 'required'").collect()}
    assert told(spark.createDataFrame([], "kind string, glob string")) == {"e1", "e2", "e3"}
    assert told(rules(("include", "/a/{}"))) == {"e1", "e2"} and told(rules(("include", "/a/*"), ("exclude", "POST *"))) == {"e1"}
    assert told(rules(("exclude", "e3"))) == {"e1", "e2"} and told(rules(("include", "/none"))) == set()


def test_paths_below_rules(spark):
    rows = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("x/y/z",), ("x/yz",), (None,), ("",)], "path string")
    rules = spark.createDataFrame([("/a/",), (".\\x\\y",), (None,)], "rule string")
    assert sorted((r.path or "-") for r in path_rules.not_excluded(rows, "path", rules, "rule").collect()) == ["-", "-", "ab", "x/yz"]


def test_names_within_texts(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abé.", k=n))
    texts = [(rng.choice("pq"), word(rng.randrange(12))) for _ in range(300)] + [("p", None), ("p", "aaa")]
    names = [(rng.choice("pqr"), word(rng.randrange(6))) for _ in range(60)] + [("p", None), ("p", "zzz"), ("q", "")]
    found = inventory.contained(spark.createDataFrame(texts, "k string, t string"), spark.createDataFrame(names, "k string, n string"), "k", "t", "n")
    assert {(r.k, r.t, r.n) for r in found.collect()} == {(k, t, n) for k, t in texts for j, n in names if k == j and t is not None and n is not None and n in t}
    assert found.count() == found.select(F.countDistinct(F.struct("k", "t", "n"))).first()[0]


def test_names_are_joined_without_sending_texts_to_all_tasks(spark):
    """However small the engine expects the tables to be: only empty names and distinct grams, both bounded, are sent to all tasks."""
    declared = spark.createDataFrame([("e", "a.bcd.1"), ("e", "xa"), ("f", "a.bcd"), ("e", None)], "ecosystem string, dependency string")
    known = spark.createDataFrame([("e", "bcd", "contains"), ("e", "a", "contains"), ("e", "xa", "exact"), ("e", "a.bcd", "prefix"), ("f", "", "contains")], "ecosystem string, name string, mode string")
    found = inventory.match_dependencies(declared, known)
    want = {("a.bcd.1", "bcd", "contains"), ("a.bcd.1", "a", "contains"), ("xa", "a", "contains"), ("xa", "xa", "exact"), ("a.bcd.1", "a.bcd", "prefix"), ("a.bcd", "", "contains")}
    assert {(r.dependency, r.name, r.mode) for r in found.collect()} == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and plan.count("BroadcastHashJoin") == 2
