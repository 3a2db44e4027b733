import itertools
import subprocess

import pytest
from pyspark.sql import functions as F

from quaymark.functions import ids, paths, text
from quaymark.operators import compatibility as compat
from quaymark.operators import consumption, correlation, extraction, inventory, merging, reach, spans
from quaymark.plans import render
from quaymark.plans.audit import audit, catalog, discover
from quaymark.registry import contract
from quaymark.sources import files, manifests, publish, wsdl


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_correlation_statuses(spark):
    consumers = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", "r2"), (4, "z", None), (5, None, None), (6, "c", "rx")], "id int, k string, stated string")
    providers = spark.createDataFrame([(10, "a", "r0"), (11, "b", "r1"), (12, "b", "r1"), (13, "c", "r2"), (14, "c", "r3"), (15, None, "r9")], "pid int, k string, repo string")
    found = {r.id: (r.candidate_count, r.proven_count, r.provider, r.status) for r in correlation.correlate(consumers, providers, ["k"], "id", "pid", "stated", ["repo"]).collect()}
    assert found == {
        1: (1, 0, 10, "unique_candidate"), 2: (2, 0, None, "ambiguous"), 3: (2, 1, 13, "matched_confirmed"),
        4: (0, 0, None, "unmatched"), 5: (0, 0, None, "unmatched"), 6: (2, 0, None, "ambiguous"),
    }


def test_two_proven_providers_are_ambiguous(spark):
    consumers = spark.createDataFrame([(1, "a", "r")], "id int, k string, stated string")
    providers = spark.createDataFrame([(10, "a", "r"), (11, "a", "r")], "pid int, k string, repo string")
    r = correlation.correlate(consumers, providers, ["k"], "id", "pid", "stated", ["repo"]).first()
    assert (r.proven_count, r.status) == (2, "ambiguous")


def test_coverage_reconciles_on_empty(spark):
    empty = spark.createDataFrame([], "id int, k string")
    none = spark.createDataFrame([], "pid int, k string")
    r = correlation.coverage(correlation.correlate(empty, none, ["k"], "id", "pid")).first()
    assert r.consumers == 0 and r.reconciled


@pytest.mark.parametrize("before,after", list(itertools.product([None, True, False], repeat=2)))
def test_requiredness_grid(spark, before, after):
    side = lambda v: F.create_map(F.lit("header:h"), F.struct(F.lit(v).cast("boolean").alias("required"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("format")))
    found = one(spark, compat.worst(compat.compare_parameters(side(before), side(after))).alias("c")).c
    assert found == ("unknown" if before is None or after is None else "breaking" if (before, after) == (False, True) else "same")


@pytest.mark.parametrize("need,location,kind,code", [
    (True, "header", "breaking", "required_header_added"), (True, "query", "breaking", "required_parameter_added"), (False, "query", "additive", "optional_query_parameter_added"),
    (False, "header", "additive", "optional_parameter_added"), (None, "header", "unknown", "header_compatibility_unknown"), (None, "query", "unknown", "parameter_requiredness_unknown"),
])
def test_new_parameters(spark, need, location, kind, code):
    new = F.create_map(F.lit(f"{location}:x"), F.struct(F.lit(need).cast("boolean").alias("required"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("format")))
    found = one(spark, compat.compare_parameters(F.lit(None).cast(compat.PARAMETERS), new).alias("f")).f
    assert [(f.classification, f.code) for f in found] == [(kind, code)]


def test_request_rules(spark):
    a = contract(request__fields=F.array(F.lit("a"), F.lit("b")), request__required_fields=F.array(F.lit("b")), request__types=F.create_map(F.lit("a"), F.lit("string")))
    b = contract(request__fields=F.array(F.lit("a"), F.lit("c"), F.lit("d"), F.lit("e")), request__required_fields=F.array(F.lit("c")), request__optional_fields=F.array(F.lit("d")), request__types=F.create_map(F.lit("a"), F.lit("integer")))
    found = one(spark, compat.compare_request(a["request"], b["request"]).alias("f")).f
    assert [(f.code, f.detail) for f in found] == [
        ("required_request_field_removed", "b"), ("required_request_field_added", "c"), ("optional_request_field_added", "d"), ("request_field_requiredness_unknown", "e"),
        ("request_field_type_changed", "a"), ("request_content_type_unknown", "missing"),
    ]


def test_response_statuses_and_tolerance(spark):
    a = contract(response__fields=F.array(F.lit("x")), response__status_codes=F.array(F.lit(200), F.lit(404)), response__tolerates_additional_fields=F.lit(True), response__types=F.create_map(F.lit("x"), F.lit("s")), response__content_type=F.lit("j"))
    b = a.withField("response.fields", F.array(F.lit("x"), F.lit("y"), F.lit("z"))).withField("response.optional_fields", F.array(F.lit("y"))).withField("response.status_codes", F.array(F.lit(200), F.lit(201), F.lit(500), F.lit(302)))
    b = b.withField("response.status_code_compatibility", F.create_map(F.lit("201"), F.lit("compatible"), F.lit("500"), F.lit("breaking")))
    found = one(spark, compat.compare_response(a["response"], b["response"]).alias("f")).f
    assert [(f.classification, f.code, f.detail) for f in found] == [
        ("breaking", "response_status_removed", "404"), ("additive", "response_status_added_compatible", "201"), ("unknown", "response_status_added_unknown", "302"),
        ("breaking", "response_status_added_breaking", "500"), ("additive", "response_fields_added_compatible", "y"), ("unknown", "response_field_addition_compatibility_unknown", "z"),
    ]


def test_weaker_authentication_follows_policy(spark):
    a, b = contract(authentication__authentication=F.lit("bearer"), authentication__authorization=F.lit("admin")), contract(authentication__authentication=F.lit("bearer"))
    for policy, kind in ((False, "same"), (True, "breaking")):
        found = one(spark, compat.compare_authentication(a["authentication"], b["authentication"], policy).alias("f")).f
        assert [(f.classification, f.code) for f in found] == [(kind, "security_policy_drift_weaker_authentication")]


def test_identical_unknown_contracts_stay_unknown(spark):
    rows_ = spark.range(1).select(F.col("id").alias("k"), contract().alias("contract"))
    r = compat.compare_contracts(rows_, rows_, ["k"]).first()
    assert r.classification == "unknown" and "contract_status" in r.unknown_reasons


def test_removed_and_added_endpoints(spark):
    side = lambda *k: spark.createDataFrame([(x,) for x in k], "k int").select("k", contract().alias("contract"))
    found = {r.k: (r.classification, r.required) for r in compat.compare_contracts(side(1, 2), side(2, 3), ["k"]).collect()}
    assert found[1] == ("breaking", True) and found[3] == ("additive", False)


def test_consumer_checks(spark):
    complete = dict(contract_status=F.lit("complete"), semantic_status=F.lit("complete"), authentication__required=F.lit(False))
    base = dict(response__fields=F.array(F.lit("x")), response__fields_used_by_consumer=F.array(F.lit("x")), response__types=F.create_map(F.lit("x"), F.lit("s")), response__content_type=F.lit("j"), response__status_codes=F.array(F.lit(200)))
    provider = contract(**complete, **base)
    cases = {1: contract(**complete, **base), 2: contract(**complete, **base | {"response__fields_used_by_consumer": F.array(F.lit("gone"))}), 3: contract(**complete | {"contract_status": F.lit("partial")}, **base)}
    consumers = None
    for k, c in cases.items():
        row = spark.range(1).select(F.lit(k).alias("id"), F.lit("GET").alias("m"), c.alias("contract"))
        consumers = row if consumers is None else consumers.unionByName(row)
    extra = spark.range(2).select((F.col("id") + 4).cast("int").alias("id"), F.when(F.col("id") == 0, "none").otherwise("two").alias("m"), contract().alias("contract"))
    providers = spark.range(1).select(F.lit("GET").alias("m"), provider.alias("contract")).unionByName(spark.range(2).select(F.lit("two").alias("m"), provider.alias("contract")))
    found = {r.id: r.status for r in consumption.check_consumers(consumers.unionByName(extra), providers, ["m"], "id").collect()}
    assert found == {1: "compatible", 2: "breaking", 3: "unknown", 4: "missing", 5: "ambiguous"}


@pytest.mark.parametrize("mode,breaking,unknown,want", [("report", True, True, "passed"), ("breaking", False, True, "passed"), ("breaking", True, False, "failed"), ("strict", False, True, "failed"), ("strict", False, False, "passed")])
def test_gates(spark, mode, breaking, unknown, want):
    assert one(spark, compat.gate(mode, F.lit(breaking), F.lit(unknown)).alias("g")).g == want


def test_merging(spark):
    df = spark.createDataFrame([("k", 3, "e3", "probable"), ("k", 1, "e1", "probable"), ("k", 2, "e1", "confirmed"), ("q", 4, "e", None)], "k string, at int, e string, c string")
    assert rows(merging.merge_evidence(df, ["k"], "at", "e", "c")) == [("k", ["e1", "e3"], "confirmed"), ("q", ["e"], None)]
    assert rows(merging.last_wins(df, ["k"], "at").select("k", "e")) == [("k", "e3"), ("q", "e")]
    with pytest.raises(merging.DuplicateIdentity):
        merging.require_unique(df, ["k"])
    merging.require_unique(df, ["at"])


def test_spans_and_reach(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, "g", 5)], "id int, f string, at int")
    held = spark.createDataFrame([("f", 0, 10, "wide"), ("f", 4, 6, "narrow"), ("f", 5, 7, "also")], "f string, lo int, hi int, name string")
    assert rows(spans.smallest_enclosing(points, held, ["f"], "id", "at", "lo", "hi", "name")) == [(1, "also"), (2, None), (3, None)]
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f")], "caller string, callee string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert rows(reach.reachable(roots, calls, 4)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("a", "e", 4)]
    facts = spark.createDataFrame([("d", "sql"), ("f", "far")], "node string, fact string")
    assert rows(reach.propagate(roots, calls, facts)) == [("a", "sql")]


def test_paths(spark):
    r = one(
        spark, paths.path_shape(F.lit("/a/{id}/{n:[0-9]+}/{x:[0-9]{2}}")).alias("shape"), paths.canonical_path(F.lit("/a/{id}/b/{n:[0-9]+}")).alias("canonical"), paths.path_parameter_names(F.lit("/{a-b}/{c}")).alias("names"),
        paths.contract_path(F.lit("https://h/p?q=1")).alias("c1"), paths.contract_path(F.lit("https://h")).alias("c2"), paths.contract_path(F.lit("/rel?q")).alias("c3"), paths.templated(F.lit("/u/${user.id}/:k/{$v}")).alias("t"),
        paths.excluded(F.lit("src/gen/a.php"), ["src/gen/"]).alias("in"), paths.excluded(F.lit("src/general"), ["src/gen"]).alias("out"), paths.selected(["GET /x/[!a]*"], F.lit("GET /x/b/c")).alias("glob"),
    )
    assert (r.shape, r.canonical, r.names) == ("/a/{}/{}/{}}", "/a/{param1}/b/{param2}", ["a-b", "c"])
    assert (r.c1, r.c2, r.c3, r["in"], r["out"], r.glob) == ("/p", "https://h", "/rel?q", True, False, True)
    assert r.t == "/u/{user}/{k}/{v}"


def test_ids_ignore_parameter_names(spark):
    shape = lambda p: ids.contract_id(F.lit("exposed"), F.lit("get"), paths.path_shape(F.lit(p)))
    r = one(spark, shape("/a/{id}").alias("x"), shape("/a/{other}").alias("y"), shape("/a/{id}/").alias("z"))
    assert r.x == r.y != r.z


def test_masking_keeps_places():
    code = "a = 'x // y'; // gone\n/* two\nlines */ b # php\n"
    shown = text.mask_code(code)
    assert len(shown) == len(code) and shown.count("\n") == 3 and "gone" not in shown and "x // y" in shown and "two" not in shown
    assert "php" in shown and "php" not in text.mask_code(code, hash_comments=True)
    assert text.split_top("a, f(b, c), 'd,e', [1, 2]") == ["a", "f(b, c)", "'d,e'", "[1, 2]"]
    assert text.matching("f('(', (a))", 1) == 10 and text.matching("(", 0) == -1


def found_in(path, code):
    return [(d, m, u, c) for d, _, m, u, _, c, _ in extraction.scan_text(path, code, {"apiUrl": "https://api.test/v1"}, {"_dio"})]


@pytest.mark.parametrize("path,code,want", [
    ("r.php", "<?php $app->get('/a/{id}', f); $app->post($x, f); // $app->put('/no', f);", [("slim", "GET", "/a/{id}", None), ("slim", None, None, "slim_dynamic_route_unresolved")]),
    ("l.php", "Route::get('/a', 'X'); Route::match(['get','put'], '/b', 'X'); Route::resource('c', 'C');", [("laravel", "GET", "/a", None), ("laravel", "GET", "/b", None), ("laravel", "PUT", "/b", None), ("laravel", None, None, "laravel_resource_unsupported")]),
    ("x.ts", "const c = axios.create({}); c.get(`/u/${id}`); axios.post(url); axios({url: 1});", [("axios", "GET", "/u/${id}", None), ("axios", None, None, "axios_dynamic_url_unresolved"), ("axios", None, None, "axios_callable_config_unsupported")]),
    ("f.js", "fetch('/a'); fetch('/b', {method: 'POST'}); fetch(x); fetch('/c', {method: m});", [("fetch", "GET", "/a", None), ("fetch", "POST", "/b", None), ("fetch", None, None, "fetch_dynamic_or_complex_call_unresolved"), ("fetch", None, None, "fetch_dynamic_or_complex_call_unresolved")]),
    ("g.php", "$c = new Client(); $c->get('/a'); $c->request('PUT', '/b'); $c->post($u);", [("guzzle", "GET", "/a", None), ("guzzle", None, None, "guzzle_dynamic_url_unresolved"), ("guzzle", "PUT", "/b", None)]),
    ("h.php", "Http::post('https://x/y'); Http::withToken('t')->get('/z');", [("laravel-http", "POST", "https://x/y", None), ("laravel-http", None, None, "laravel_http_complex_call_unresolved")]),
    ("n.ts", "class A { constructor(private http: HttpClient) {} f() { this.http.get<X>(this.apiUrl + '/users/' + id); this.http.delete(q()); } }", [("angular", "GET", "https://api.test/v1/users/{value}", None), ("angular", None, None, "angular_httpclient_dynamic_url_unresolved")]),
    ("d.dart", "import 'package:http/http.dart' as http; http.get(Uri.parse('https://x/$id')); http.post(u);", [("dart-http", "GET", "https://x/{id}", None), ("dart-http", None, None, "dart_http_complex_uri_unresolved")]),
    ("e.dart", "_dio.get('/a'); myDio.post('/b'); final dio = Dio(); dio.put(url);", [("dio", "GET", "/a", None), ("dio", None, None, "dio_receiver_unresolved"), ("dio", None, None, "dio_dynamic_url_unresolved")]),
    ("c.php", "$h = curl_init('https://x/a/' . $id); curl_setopt($h, CURLOPT_POST, true); curl_exec($h); $k = curl_init($u); curl_exec($k);", [("php-curl", "POST", "https://x/a/{id}", None), ("php-curl", None, None, "php_curl_url_unresolved")]),
    ("s.php", "$s = new SoapClient('a.wsdl'); $s->Login($x); $s->__soapCall($op, []);", [("soap", "Login", "a.wsdl", None), ("soap", None, None, "soap_operation_unresolved")]),
    ("t.php", "<?php // nothing here\n", []),
])
def test_detectors(path, code, want):
    assert found_in(path, code) == want


def test_discovery_merges_and_reports(spark):
    data = [("r", "a.php", "<?php\n$app->get('/a', f);\n$app->get('/a', g);\n"), ("r", "b.php", "<?php\n$app->get($x, f);\n"), ("r", "bad.php", None), ("r", "e.ts", "")]
    found, open_ = discover(spark.createDataFrame(data, "repository_id string, path string, text string"))
    assert rows(found.select("method", "path", "evidence", "confidence")) == [("GET", "/a", ["a.php:2", "a.php:3"], "confirmed")]
    assert rows(open_.select("path", "code", "line")) == [("b.php", "slim_dynamic_route_unresolved", 2)]
    assert catalog(found, exclude=("GET /a",)).first().scope == "excluded"


def test_manifests(spark):
    data = [
        ("r", "composer.json", '{"require": {"slim/slim": "4"}}'), ("r", "x/package.json", '{"devDependencies": {"axios": "1"}}'), ("r", "package.json", "{"), ("r", "requirements.txt", "Foo_Bar>=1\n# no\n"),
        ("r", "pubspec.yaml", "name: x\ndependencies:\n  dio: ^5\n  http:\n    git: y\n"), ("r", "go.mod", "require github.com/a/b v1.2.3\n"), ("r", "pom.xml", "<p xmlns='u'><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></p>"),
        ("r", "pyproject.toml", '[project]\ndependencies = ["Requests>2"]\n'), ("r", "App.csproj", '<P><PackageReference Include="Json.Net"/></P>'), ("r", "src/a.php", "x"),
    ]
    found = manifests.manifest_dependencies(spark.createDataFrame(data, "repository_id string, path string, text string"))
    assert {(r.ecosystem, r.dependency or r.error) for r in found.collect()} == {
        ("composer", "slim/slim"), ("npm", "axios"), ("npm", "JSONDecodeError"), ("python", "foo-bar"), ("dart", "dio"), ("dart", "http"), ("go", "github.com/a/b"), ("maven", "g:a"), ("python", "requests"), ("dotnet", "Json.Net"),
    }


def test_wsdl(spark):
    good = "<definitions xmlns='w'><portType name='P'><operation name='Login'><input message='t:In'/><output message='t:Out'/></operation></portType><service name='S'><port name='p' binding='t:B'/></service></definitions>"
    found = wsdl.read_contracts(spark.createDataFrame([("r", "a.wsdl", good), ("r", "b.WSDL", "<"), ("r", "c.wsdl", "<d/>")], "repository_id string, path string, text string"))
    assert rows(found.select("path", "operation", "service", "binding", "input", "error")) == [("a.wsdl", "Login", "S", "B", "In", None), ("b.WSDL", None, None, None, None, "invalid"), ("c.wsdl", None, None, None, None, "empty")]
    calls = spark.createDataFrame([("Login",), ("Gone",)], "operation string")
    assert rows(wsdl.meet_contracts(calls, found.select("operation", "service"), ["operation"]).select("operation", "defined_in_wsdl")) == [("Gone", False), ("Login", True)]


def test_publish_is_whole_or_nothing(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    df = spark.createDataFrame([("password=hunter2",)], "t string")
    publish.publish(spark, target, {"a": df})
    assert spark.read.json(f"{target}/a").first().t == "password=[REDACTED]"

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        publish.publish(spark, target, {"a": spark.createDataFrame([("new",)], "t string")}, check=refuse)
    assert spark.read.json(f"{target}/a").first().t == "password=[REDACTED]"
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(publish.SecretFound):
        publish.require_no_secrets(df)


def test_sets_belong_together(spark, tmp_path):
    part = lambda name, commit: spark.createDataFrame([("r", commit)], "repository_id string, source_commit string").write.json(f"{tmp_path}/{name}")
    part("a", "1")
    part("b", "1")
    spark.createDataFrame([], "x int").write.json(f"{tmp_path}/empty")
    publish.require_set(spark, str(tmp_path), ["a", "b", "empty"])
    part("c", "2")
    for parts in (["a", "c"], ["a", "gone"]):
        with pytest.raises(publish.NotWhole):
            publish.require_set(spark, str(tmp_path), parts)


def test_curl_handles_end_with_their_function():
    code = "<?php function a() { $h = curl_init('http://x/a'); curl_setopt($h, CURLOPT_POST, true); } function b() { curl_exec($h); } function c() { $h = curl_init('http://x/c'); curl_exec($h); }"
    assert found_in("h.php", code) == [("php-curl", None, None, "php_curl_url_unresolved"), ("php-curl", "GET", "http://x/c", None)]


def test_audit_of_a_work_tree(spark, tmp_path):
    repo = tmp_path / "shop"
    (repo / "vendor").mkdir(parents=True)
    (repo / "routes.php").write_text("<?php\n$app->get('/orders/{id}', function ($q, $r) { return $r->withJson(['id' => 7], 200); });\n")
    (repo / "vendor" / "x.php").write_text("<?php $app->get('/vendored', f);")
    (repo / "composer.json").write_text('{"require": {"slim/slim": "4"}}')
    for arguments in (("init", "-q"), ("add", "-A"), ("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x")):
        subprocess.run(["git", "-C", str(repo), *arguments], check=True)
    found = audit(spark, str(repo))
    assert rows(found["endpoints"].select("repository_id", "method", "path")) == [("shop", "GET", "/orders/{id}")]
    assert rows(found["dependencies"].select("dependency")) == [("slim/slim",)]
    assert found["status"].first().status == "complete" and found["status"].first().dirty is False
    assert found["status"].first().contract_scope == "evaluated_complete" and audit(spark, str(repo), require_correlation=True)["status"].first().correlation_scope == "not_applicable"
    with pytest.raises(files.SnapshotError):
        files.verify_snapshot(str(repo / "vendor"))
    with pytest.raises(files.SnapshotError):
        files.verify_snapshot(str(repo), "nowhere")


def test_streaming_appends_new_files(spark, tmp_path):
    from quaymark.streaming.incremental import stream_endpoints

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.php").write_text("<?php $app->get('/a', f);")
    run = lambda: stream_endpoints(spark, str(tmp_path / "in"), "r", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    run()
    (tmp_path / "in" / "b.php").write_text("<?php $app->get('/b', f);")
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("endpoint")) == [("/a",), ("/b",)]


def test_reports(spark):
    endpoints = spark.createDataFrame([("e1", "exposed", "GET", "/a/{id}"), ("e2", "exposed", "POST", "/a/{key}"), ("e3", "consumed", "GET", "/b")], "endpoint_id string, direction string, method string, path string")
    shown = "\n".join(r.text for r in render.joined(render.openapi_lines(endpoints)).orderBy("section").collect())
    assert "/a/{param1}:" in shown and "name: param1" in shown and "/b" not in shown
    render.require_distinct_paths(render.grouped_paths(endpoints))
    with pytest.raises(render.AmbiguousPath):
        render.require_distinct_paths(render.grouped_paths(endpoints.withColumn("method", F.lit("get"))))


def test_inventory_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    none = spark.createDataFrame([], "name string, kind string, pattern string, extensions array<string>")
    assert inventory.detect(empty, none, "doc_id", "text").count() == 0


def test_dependencies_and_signatures_beyond_a_bound(spark):
    known = spark.range(12_000).selectExpr("'e' AS ecosystem", "concat('lib', id, '.x') AS name", "CASE WHEN id % 2 = 0 THEN 'exact' ELSE 'prefix' END AS mode")
    declared = spark.range(12_000).selectExpr("id", "'e' AS ecosystem", "concat('lib', id, CASE WHEN id % 2 = 0 THEN '.x' ELSE '.x.y' END) AS dependency")
    assert inventory.match_dependencies(declared, known).select("id").distinct().count() == 12_000
    few = spark.createDataFrame([("e", "a", "contains"), ("e", "a.b", "prefix"), ("e", "a.b", "exact"), ("f", "a", "contains"), ("e", "a.b", None)], "ecosystem string, name string, mode string")
    given = spark.createDataFrame([("e", "a.b"), ("e", "a.bc"), ("e", "a.b.c"), ("e", None), ("e", "x")], "ecosystem string, dependency string")
    found = sorted((r.dependency, r.name, r["mode"] or "") for r in inventory.match_dependencies(given, few).collect())
    assert found == [("a.b", "a", "contains"), ("a.b", "a.b", ""), ("a.b", "a.b", "exact"), ("a.b", "a.b", "prefix"), ("a.b.c", "a", "contains"), ("a.b.c", "a.b", ""), ("a.b.c", "a.b", "prefix"), ("a.bc", "a", "contains")]
    many = spark.range(1001).selectExpr("concat('s', id) AS name", "'k' AS kind", "'zzz' AS pattern", "CAST(NULL AS array<string>) AS extensions")
    with pytest.raises(ValueError):
        inventory.detect(spark.createDataFrame([(1, "a")], "k int, t string"), many, "k", "t")


def test_audit_is_partial_over_unread_files(spark, tmp_path):
    (tmp_path / "big.js").write_text("x" * (files.MAX_BYTES + 1))
    (tmp_path / "odd.py").write_bytes(b"a = '\xff'")
    (tmp_path / "logo.png").write_bytes(b"\x89PNG\xff")
    for line in (["init", "-q"], ["add", "."], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-qm", "m"]):
        subprocess.run(["git", "-C", str(tmp_path), *line], check=True)
    found = audit(spark, str(tmp_path))
    assert found["status"].first().status == "partial"
    assert sorted((r.path, r.code) for r in found["unresolved"].collect()) == [("big.js", "skipped_oversize"), ("odd.py", "text_read_failed")]


def commit(repo):
    for arguments in (("init", "-q"), ("add", "-A"), ("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x")):
        subprocess.run(["git", "-C", str(repo), *arguments], check=True)


def test_from_audit_to_check(spark, tmp_path):
    """Each verb reads what the verb before it published."""
    from quaymark import __main__ as cli

    route = "<?php\n$app->post('/orders/{id}', function ($q, $r) { $d = $q->getParsedBody(); $n = (int) $d['n']; $m = $d['m'] ?? ''; return $r->withJson(['id' => 7%s], 201); });\n"
    for name, more in (("old", ", 'state' => 'x'"), ("new", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "routes.php").write_text(route % more)
        commit(tmp_path / name)
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "a.js").write_text("import axios from 'axios';\naxios.post('/orders/{key}', body);\n")
    commit(tmp_path / "app")
    out = lambda name, part="": f"{tmp_path}/out-{name}" + (f"/{part}" if part else "")
    codes = {}
    for name in ("old", "new", "app"):
        codes[name] = cli.run(spark, cli.parser().parse_args(["audit", str(tmp_path / name), "--output", out(name)]))
        assert cli.run(spark, cli.parser().parse_args(["catalog", "--findings", out(name, "findings"), "--output", out(f"{name}-catalog")])) == 0
    assert codes == {"old": 0, "new": 0, "app": 0}
    made = spark.read.json(out("old-catalog", "catalog")).first()
    (e,) = made.endpoints
    assert (e.method, e.path_shape, e.scope, e.contract.contract_status) == ("POST", "/orders/{}", "required", "complete") and e.evidence[0].path == "routes.php" and e.evidence[0].line == 2
    assert e.contract.request.fields == ["m", "n"] and e.contract.request.optional_fields == ["m"] and e.contract.request.unknown_requiredness_fields == ["n"] and e.contract.response.status_codes == [201]
    run = lambda *a: cli.run(spark, cli.parser().parse_args([*a]))
    assert run("correlate", "--findings", out("app", "findings"), "--findings", out("old", "findings"), "--output", out("links")) == 0
    assert [r.status for r in spark.read.json(out("links", "correlations")).collect()] == ["unique_candidate"]
    assert run("compare", "--reference", out("old-catalog", "catalog"), "--candidate", out("new-catalog", "catalog"), "--gate", "breaking", "--output", out("compared")) == 3
    record = spark.read.json(out("compared", "records")).first()
    assert record.classification == "breaking" and [x.path for x in record.evidence] == ["routes.php", "routes.php"]
    assert run("check", "--consumers", out("app-catalog", "catalog"), "--providers", out("old-catalog", "catalog"), "--output", out("checked")) == 0
    assert len(spark.read.json(out("checked", "inputs")).first().sha256) == 64
    assert spark.read.json(out("links", "correlations")).first().consumer_evidence[0].path == "a.js" and spark.read.json(out("checked", "records")).first().evidence[0].line == 2
    read = lambda name, page: (tmp_path / f"out-{name}" / page).read_text().split("\n")
    assert read("old", "openapi.yaml")[0] == "openapi: 3.1.0" and read("old", "openapi.yaml")[6:8] == ["  /orders/{param1}:", "    post:"]
    assert any(x.startswith("      requestBody: {content: {\"application/json\": {schema: ") and "\"m\"" in x for x in read("old", "openapi.yaml")) and any("\"201\": " in x for x in read("old", "openapi.yaml"))
    assert read("old", "audit-report.md")[:1] == ["---"] and "status: complete" in read("old", "audit-report.md") and "## POST /orders/{id}" in read("old", "api-knowledge.md")
    assert any(x.startswith("| unique_candidate | ") for x in read("links", "correlations.md")) and any(x.startswith("## POST /orders/{} exposed: breaking") for x in read("compared", "compatibility.md"))
    assert read("checked", "consumers.md")[0] == "# What consumers need"


def test_gate_sees_what_is_open(spark, tmp_path):
    (tmp_path / "a.php").write_text("<?php\n$app->get('/a', f);\n$s = new SoapClient('w/a.wsdl'); $s->Login($x); $s->Gone($x);\n$t = new SoapClient('http://x/b.wsdl'); $t->Far($x);\n")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.wsdl").write_text("<definitions xmlns='w'><portType name='P'><operation name='Login'/></portType></definitions>")
    (tmp_path / "m.py").write_text("import requests\nfrom flask import Flask\n")
    (tmp_path / "b.php").write_text("<?php\nuse GuzzleHttp\\Client;\n")
    commit(tmp_path)
    found = audit(spark, str(tmp_path), require_correlation=True)
    state = found["status"].first()
    assert (state.status, state.contract_scope, state.correlation_scope) == ("partial", "required_not_complete", "required_not_evaluable")
    codes = {(r.detector, r.code) for r in found["unresolved"].collect()}
    assert codes >= {("requests", "unsupported_http_client"), ("flask", "unsupported_framework"), ("guzzle", "detector_without_hits"), ("soap", "soap_contract_operation_missing"), ("soap", "soap_contract_remote")}
    plan = found["plan"].first()
    report = "\n".join(r.line for r in found["report"].orderBy("section", "position").collect())
    assert "- status: partial. Something is open" in report and "- open: soap_contract_remote (soap), 1, first at a.php" in report and "- exposed: 1, with a complete contract: 0" in report
    page = [r.line for r in found["knowledge"].orderBy("section", "position").collect()]
    assert "## GET /a" in page and "- contract: unresolved, semantics: unknown" in page and "- tags: exposed, get" in page
    assert plan.categories == ["inventory", "framework", "configuration", "exposed", "consumed", "integration"] and "exposed:flask" in plan.hints and "integration:soap" in plan.hints


def test_curl_wrappers(spark):
    one = r"""<?php
class Client {
  public function run() { return $this->request('GET', 'https://example.com/items'); }
  public function more($id) { return $this->request('post', "https://example.com/items/$id"); }
  private function request($method, $url) { return $this->send($method, $url); }
  private function send($method, $url) {
    $ch = curl_init($url);
    curl_setopt($ch, CURLOPT_CUSTOMREQUEST, $method);
    return curl_exec($ch);
  }
}
"""
    other = one.replace("'GET', 'https://example.com/items'", "$m, $this->url()")
    rest = "<?php function f($u) { $c = curl_init($u); return curl_exec($c); }\nfunction g() { return f('http://x/a'); }\nfunction h($u) { return g($u); }"
    data = [("r", "one.php", one), ("r", "other.php", other), ("r", "rest.php", rest), ("r", "none.php", None)]
    found, open_ = discover(spark.createDataFrame(data, "repository_id string, path string, text string"))
    seen = {(r.method, r.path, e) for r in found.collect() for e in r.evidence}
    assert seen == {("GET", "/items", "one.php:3"), ("POST", "/items/{id}", "one.php:4"), ("POST", "/items/{id}", "other.php:4"), ("GET", "/a", "rest.php:2")}
    assert rows(open_.select("path", "code")) == [("other.php", "php_curl_url_unresolved")]
