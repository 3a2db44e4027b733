import json

import pytest
from pyspark.sql import functions as F

from quaymark.operators import enrichment

CODE = r"""<?php
function loadUser($db, $id) { $sql = 'SELECT * FROM users'; $sql .= ' WHERE id = ?'; $db->prepare($sql); audit($db); return 1; }
function audit($db) { $db->exec('INSERT INTO audit_log VALUES (1)'); loadUser($db, 2); }
$app->post('/orders/{id}', function ($request, $response) {
    $data = $request->getParsedBody();
    $customer = $data['customer'];
    $name = (string) $customer['name'];
    $note = $data['note'] ?? '';
    foreach ($data['items'] as $item) { $q = (int) $item['quantity']; }
    // $data['commented']
    $token = JWT::decode($request->getHeaderLine('Authorization'), $key); // Bearer
    if ($token->role != 'admin') { return $response->withJson(['error' => 'no'], 403); }
    loadUser($db, 1);
    $ch = curl_init('https://pay.test/charge');
    return $response->withJson(['id' => 7, 'state' => 'ok', 'total' => $t], 201);
})->add(AuthMiddleware::class);
$app->get('/plain', function ($request, $response) { $f = 'x'; $f(); return $db->query($dynamic); });
"""


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("r", "routes.php", CODE), ("r", "no.txt", "x"), ("r", "bad.php", None)], "repository_id string, path string, text string")
    return enrichment.facts(files)


def of(found, owner, kind):
    return sorted((r.name, r.value) for r in found.where((F.col("owner") == owner) & (F.col("kind") == kind)).collect())


def test_contract_facts(found):
    route = "POST /orders/{id}"
    fields = {n: json.loads(v) for n, v in of(found, route, "request_field")}
    assert fields["customer.name"] == {"type": "string", "required": None} and fields["items.[].quantity"]["type"] == "integer"
    assert fields["note"]["required"] is False and "commented" not in fields
    assert {n for n, _ in of(found, route, "response_field")} == {"error", "id", "state", "total"} and {n for n, _ in of(found, route, "status_code")} == {"403", "201"}
    assert of(found, route, "authentication") == [("jwt", "raw")] and of(found, route, "middleware") == [("AuthMiddleware::class", None)]
    assert of(found, route, "claim_consumed") == [("role", None)] and of(found, route, "outbound_http") == [("https://pay.test/charge", None)]


def test_schema(found):
    schema = json.loads(enrichment.body_schemas(found).first().schema)
    assert schema["properties"]["customer"]["properties"]["name"] == {"type": "string"}
    assert schema["properties"]["items"] == {"type": "array", "items": {"type": "object", "properties": {"quantity": {"type": "integer"}}}}


def test_helpers_hand_on_their_facts(found):
    rows = enrichment.behaviour(found)
    tables = {(r.name, r.value) for r in rows.where("owner = 'POST /orders/{id}' AND kind = 'data_access'").collect()}
    assert tables == {("users", "read"), ("audit_log", "write")}
    state = {r.owner: r.status for r in enrichment.semantic_status(rows).collect()}
    assert state == {"POST /orders/{id}": "partial", "GET /plain": "unresolved"}
    open_ = {(r.name, r.value) for r in rows.where("owner = 'POST /orders/{id}' AND kind = 'unresolved'").collect()}
    assert open_ == {("slim_php_semantic_helper_cycle", "loadUser"), ("slim_php_semantic_helper_cycle", "audit")}


def test_helpers_beyond_the_depth_are_open(spark):
    chain = "".join(f"function f{k}() {{ f{k + 1}(); }}\n" for k in range(6)) + "function f6() { $db->query('SELECT 1 FROM far'); }\n"
    code = f"<?php\n{chain}$app->get('/x', function ($q, $r) {{ f0(); return $r->withJson(['a' => 1]); }});\n"
    found = enrichment.facts(spark.createDataFrame([("r", "a.php", code)], "repository_id string, path string, text string"))
    of_route = lambda depth: {(r.kind, r.name, r.value) for r in enrichment.behaviour(found, depth).where("kind IN ('data_access', 'unresolved')").collect()}
    assert of_route(4) == {("unresolved", "slim_php_semantic_helper_depth_limit", "f4")} and of_route(7) == {("data_access", "far", "read")}


def test_empty(spark):
    none = spark.createDataFrame([], "repository_id string, path string, text string")
    assert enrichment.behaviour(enrichment.facts(none)).count() == 0


def test_bodies_handed_to_local_functions(spark):
    code = r"""<?php
function sendMails($list, $x) { foreach ($list as $k => $one) { $mail = (string) $list[$k]["mail"]; $n = $one['name'] ?? ''; } $x['other']; }
function twice($p) { $p['a']; }
function twice($p) { return true; }
$app->post('/send', function ($q, $r) { $params = json_decode($q->getBody(), true); sendMails($params['rows'], $params); return $r; });
$app->post('/twice', function ($q, $r) { $params = $q->getParsedBody(); twice($params); return $r; });
"""
    found = enrichment.facts(spark.createDataFrame([("r", "a.php", code)], "repository_id string, path string, text string"))
    fields = {n: json.loads(v) for n, v in of(found, "POST /send", "request_field")}
    assert set(fields) == {"rows", "rows.[].mail", "rows.[].name", "other"} and fields["rows.[].mail"]["type"] == "string" and fields["rows.[].name"]["required"] is False
    assert of(found, "POST /twice", "request_field") == [] and ("slim_php_request_function_ambiguous", "twice") in of(found, "POST /twice", "unresolved")
