"""What an audit must show rather than lose."""

import pytest
from pyspark.sql import functions as F

from quaymark.operators import enrichment, wrappers
from quaymark.plans import assembly, audit


def tree(spark, *files):
    return spark.createDataFrame([(repository, path, text) for repository, path, text in files], "repository_id string, path string, text string")


CURL = "function w($u) { $h = curl_init($u); return curl_exec($h); }\n"


def found(spark, *files):
    endpoints, open_ = audit.discover(tree(spark, *files))
    return sorted((r.repository_id, r.method, r.path, r.base_url) for r in endpoints.collect()), sorted((r.path, r.code) for r in open_.collect())


@pytest.mark.parametrize(("case", "code", "paths", "is_open"), [
    ("a chain beyond the last step", CURL + "function f0($u) { w($u); }\n" + "".join(f"function f{k}($u) {{ f{k - 1}($u); }}\n" for k in range(1, 12)) + "function g() { f11('https://h.x/deep'); }\nfunction e() { w('https://h.x/near'); }", ["/near"], True),
    ("a caller that nobody calls", CURL + "function f1($u) { w($u); }\nfunction g() { w('https://h.x/a'); }", ["/a"], True),
    ("a cycle", CURL + "function f1($u) { f2($u); w($u); }\nfunction f2($u) { f1($u); }\nfunction g() { w('https://h.x/a'); }", ["/a"], True),
    ("all callers say the URL", CURL + "function f1($u) { w($u); }\nfunction g() { f1('https://h.x/b'); w('https://h.x/a'); }", ["/a", "/b"], False),
])
def test_open_calls_stay_open(spark, case, code, paths, is_open):
    endpoints, open_ = found(spark, ("r", "a.php", "<?php\n" + code))
    assert [e[2] for e in endpoints] == paths and all(e[3] == "https://h.x" for e in endpoints), case
    assert (("a.php", "php_curl_url_unresolved") in open_) == is_open, case


def test_constants_stay_in_their_repository(spark):
    service = "import { HttpClient } from 'x';\nclass S { constructor(private http: HttpClient) {} a() { return this.http.get(`${environment.api}/users`); } }"
    endpoints, _ = found(spark, ("a", "environment.ts", "export const environment = { api: 'https://a.example' };"), ("a", "s.ts", service), ("b", "s.ts", service))
    assert ("a", "GET", "/users", "https://a.example") in endpoints
    assert not [e for e in endpoints if e[0] == "b" and e[3] == "https://a.example"]


def test_an_endpoint_with_two_addresses_has_none(spark):
    code = "<?php\n$a = curl_init('https://h.x/a'); curl_exec($a);\n$b = curl_init('https://h.y/a'); curl_exec($b);\n$c = curl_init('https://h.y/b'); curl_exec($c);"
    endpoints, _ = found(spark, ("r", "a.php", code))
    assert endpoints == [("r", "GET", "/a", None), ("r", "GET", "/b", "https://h.y")]


def contracts(spark, *files):
    facts = enrichment.facts(tree(spark, *files))
    rows = assembly.route_contracts(facts, enrichment.behaviour(facts)).collect()
    return {r.endpoint: r for r in rows}, {(r.name, r.value) for r in facts.where("kind = 'unresolved'").collect()}


def test_uploads_and_middleware_reach_the_contract(spark):
    route = lambda path, tail: f"$app->post('{path}', function ($q, $s) {{ $f = $q->getUploadedFiles(); $x = $f['photo']; return $s->withJson(['ok' => true], 201); }}){tail};\n"
    code = "<?php\n" + route("/open", "") + route("/guarded", "->add(AuthMiddleware::class)") + route("/other", "->add(new App\\Gone())") + route("/plain", "->add(new Logger)")
    classes = "<?php\nclass AuthMiddleware { function __invoke($q, $s, $n) { $t = $q->getHeaderLine('Authorization'); $t = str_replace('Bearer ', '', $t); $c = JWT::decode($t, $k); return $n($q, $s); } }\nclass Logger { function __invoke($q, $s, $n) { return $n($q, $s); } }"
    rows, open_ = contracts(spark, ("r", "a.php", code), ("r", "b.php", classes), ("q", "b.php", "<?php class Gone { }"))
    for path in ("/open", "/guarded", "/other", "/plain"):
        request = rows[path].contract.request
        assert request.fields == ["photo"] and request.content_type == "multipart/form-data" and request.unknown_requiredness_fields == ["photo"]
    assert rows["/open"].contract_note == "complete" and rows["/open"].contract.authentication.authentication is None
    assert rows["/guarded"].contract_note == "complete" and rows["/guarded"].contract.authentication.authentication == "jwt" and rows["/guarded"].contract.authentication.credential_format == "bearer"
    assert rows["/other"].contract_note == rows["/plain"].contract_note == "partial"
    assert {(n, v) for n, v in open_ if "security" in n} == {("slim_php_security_middleware_unresolved", "App\\Gone"), ("slim_php_security_middleware_unresolved", "Logger")}


def test_findings_tell_the_address(spark):
    endpoints, _ = audit.discover(tree(spark, ("r", "a.php", "<?php $c = curl_init('https://h.y/b'); curl_exec($c);")))
    facts = enrichment.facts(tree(spark, ("r", "x.php", "<?php")))
    rows = assembly.with_contracts(endpoints, assembly.route_contracts(facts, enrichment.behaviour(facts)))
    status = spark.createDataFrame([("r", "abcdef1", "complete")], "repository_id string, source_commit string, status string")
    document = assembly.findings_documents(rows, status).select(F.explode("endpoints").alias("e")).first().e
    assert (document.path, document.base_url) == ("/b", "https://h.y")


def test_deep_chains_are_followed_as_far_as_asked(spark):
    code = "<?php\n" + CURL + "function f($u) { w($u); }\nfunction g() { f('https://h.x/a'); }"
    for most, paths, whole in ((1, [], [False]), (2, ["https://h.x/a"], [True])):
        calls, functions = wrappers.wrapped_calls(tree(spark, ("r", "a.php", code)), most)
        assert [r.url for r in calls.collect()] == paths and [r.whole for r in functions.collect()] == whole


def test_hiding_by_marks_equals_all_patterns(spark, sf_dir):
    """Patterns are passed over only where they would change nothing, whatever they hid before; a small file's rows are dealt to several tasks."""
    import random
    import re

    from pyspark.sql import functions as F

    from quaymark import registry
    from quaymark.functions import text

    rng = random.Random(2)
    pieces = ["password", "Api-Key", "client_secret", "SESSION token", "Authorization", "sig", "token", ":", "=", " ", '"', "'", '\\"', "?", "&", "://", "@", "bearer ", "x", "null", "[REDACTED]", "{", "}", ",", "\n", "Key", "a"]
    rows = spark.createDataFrame([(k, "".join(rng.choices(pieces, k=rng.randrange(12)))) for k in range(4000)] + [(4000, None)], "k int, t string")
    plain = F.col("t")
    for pattern, kept in text._HIDING:
        plain = F.regexp_replace(plain, re.sub(r"\(\?=\[[a-z]+\]\)", "", pattern), kept.format(text.HIDDEN.replace("[", r"\[")))
    assert rows.where(~text.redact(F.col("t")).eqNullSafe(plain)).collect() == [] and rows.where(plain != F.col("t")).count() > 100
    assert "REPARTITION_BY_NUM" in registry.queries()["nested_secrets"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
