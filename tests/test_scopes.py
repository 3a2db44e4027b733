"""The innermost of nested scopes, and integrations within routes."""

import random

import pytest

from quaymark.operators import enrichment, spans


def nested(rng, lo, hi, depth, out):
    """Random nested, touching and empty spans."""
    at = lo
    while depth and at < hi:
        start = rng.randint(at, hi)
        end = rng.choice([start, rng.randint(start, hi)])
        out.append((start, end))
        nested(rng, start, end, depth - 1, out)
        at = end + rng.choice([0, 0, 1, 3])
    return out


@pytest.mark.parametrize("block", [1, 4, 50, 1 << 16])
def test_innermost_scope_equals_a_search(spark, block):
    rng = random.Random(block)
    held = [(f, lo, hi, f"{f}:{lo}:{hi}:{k:03}") for f in "abc" for k, (lo, hi) in enumerate(nested(rng, 0, 120, 4, []))]
    held += [("whole", 0, 10_000, "all"), ("whole", 5, 5, "empty"), ("whole", 9, 2, "turned")]
    points = [(k, f, at) for k, (f, at) in enumerate([(f, at) for f in "abcd" for at in range(-2, 124)] + [("whole", at) for at in (0, 5, 9_999, 10_000)])]
    found = spans.innermost_scope(spark.createDataFrame(points, "id int, f string, at int"), spark.createDataFrame(held, "f string, lo int, hi int, name string"), ["f"], "id", "at", "lo", "hi", "name", block)
    want = {}
    for k, f, at in points:
        around = [(hi - lo, [-ord(c) for c in name], name) for g, lo, hi, name in held if g == f and lo <= at < hi]
        want[k] = min(around)[2] if around else None
    assert {r.id: r.name for r in found.collect()} == want


def test_integrations_are_laid_onto_routes(spark):
    code = "<?php\n$app->get('/a', function ($q, $s) {\n  $c = new SoapClient('x.wsdl');\n  $c->Login();\n  return $s;\n});\n$c->Outside();\nfunction help() {\n  $c->Helper();\n}\n"
    facts = enrichment.facts(spark.createDataFrame([("r", "a.php", code)], "repository_id string, path string, text string"))
    calls = spark.createDataFrame([("r", "a.php", 4, "Login", "x.wsdl"), ("r", "a.php", 7, "Outside", "x.wsdl"), ("r", "a.php", 9, "Helper", "x.wsdl"), ("q", "a.php", 4, "Other", "x.wsdl")], "repository_id string, path string, line int, operation string, target string")
    laid = enrichment.laid_onto_routes(facts, calls).where("kind = 'outbound_soap' AND value = 'x.wsdl'").collect()
    assert sorted((r.owner, r.endpoint, r.name) for r in laid) == [("GET /a", "/a", "Login"), ("help", None, "Helper")]


def test_blocks_are_dealt_by_the_rows_they_hold(spark, monkeypatch):
    """The number of tasks grows with spans and points, and only spans that go on in a later block are handed there."""
    monkeypatch.setattr(spans, "SWEPT", 10)
    held = [("f", 0, 400, "all"), ("f", 5, 35, "a"), ("f", 35, 50, "b"), ("f", 36, 40, "c"), ("f", 120, 170, "d")] + [("f", k, k + 1, f"s{k}") for k in range(200, 240)]
    points = [(at, "f", at) for at in range(-5, 405, 5)]
    found = spans.innermost_scope(spark.createDataFrame(points, "id int, f string, at int"), spark.createDataFrame(held, "f string, lo int, hi int, name string"), ["f"], "id", "at", "lo", "hi", "name", 20)
    assert {r.id: r.name for r in found.collect()} == {at: min(((hi - lo, name) for _, lo, hi, name in held if lo <= at < hi), default=(0, None))[1] for at, _, _ in points}
    tasks = -(-(2 * len(held) + len(points)) // 10)
    assert f", {tasks}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
