"""Body schemas folded level by level, against a plain merge."""

import json
import random

from quaymark.operators import enrichment
from quaymark.plans import render


def test_fold_equals_a_plain_merge(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for owner in range(40):
        paths: dict[str, dict] = {}
        own = []
        for line in range(1, rng.randrange(2, 9)):
            name = ".".join(rng.choice(["a", 'b"', "[]", "é"]) for _ in range(rng.randrange(1, 5)))
            own.append((line, name, {"type": rng.choice([None, "string", "integer"]), "required": rng.choice([None, True, False])}))
        for _, name, value in sorted(own, key=lambda x: (x[0], x[1])):
            for k, v in value.items():
                if v is not None:
                    paths.setdefault(name, {}).setdefault(k, v)
            paths.setdefault(name, {})
        rows += [("r", str(owner), "POST", "request_field", name, json.dumps(value), line) for line, name, value in own]
        want[str(owner)] = (own, paths)
    found = {r.owner: json.loads(r.schema) for r in enrichment.body_schemas(spark.createDataFrame(rows, "repository_id string, owner string, method string, kind string, name string, value string, line int")).collect()}
    for owner, (own, paths) in want.items():
        root: dict = {"type": "object"}
        for line, name, value in sorted(own, key=lambda x: (x[0], x[1])):
            node, keys = root, name.split(".")
            for k, key in enumerate(keys):
                if key == "[]":
                    node["type"] = "array"
                    node = node.setdefault("items", {})
                else:
                    node.setdefault("type", "object")
                    if k == len(keys) - 1 and paths[name].get("required"):
                        node["required"] = sorted({*node.get("required", []), key})
                    node = node.setdefault("properties", {}).setdefault(key, {})
            if value["type"]:
                node.setdefault("type", value["type"])
        assert found[owner] == root, owner


def test_fold_of_nothing(spark):
    rows = spark.createDataFrame([], "repository_id string, owner string, method string, kind string, name string, value string, line int")
    assert enrichment.body_schemas(rows).collect() == []


FACTS = "repository_id string, owner string, method string, endpoint string, kind string, name string, value string, line int"


def test_bodies_of_routes(spark):
    """Uploads are fields; equal bodies of one route are one, differing ones none; facts of functions without a route have no body."""
    rows = [
        ("r", "1", "POST", "/a/{x}", "request_field", "n.[].m", '{"type":"integer","required":true}', 2), ("r", "1", "POST", "/a/{x}", "multipart_field", "file", None, 3), ("r", "1", "POST", "/a/{x}", "status_code", "201", None, 4),
        ("r", "2", "PUT", "/b", "request_field", "k", "{}", 2), ("r", "3", "PUT", "/b", "request_field", "k", "{}", 9), ("r", "4", "PUT", "/c", "request_field", "k", "{}", 2), ("r", "5", "PUT", "/c", "request_field", "l", "{}", 2),
        ("s", "1", "PUT", "/c", "request_field", "k", "{}", 2), ("r", "6", None, None, "request_field", "k", "{}", 2), ("r", "7", "GET", "/d", "status_code", "200", None, 1),
    ]
    found = {(r.repository_id, r.method, r.path): (r.content_type, json.loads(r.schema)) for r in enrichment.route_bodies(spark.createDataFrame(rows, FACTS)).collect()}
    k = ("application/json", {"type": "object", "properties": {"k": {}}})
    item = {"type": "object", "properties": {"m": {"type": "integer"}}, "required": ["m"]}
    assert found == {("r", "POST", "/a/{x}"): ("multipart/form-data", {"type": "object", "properties": {"file": {"type": "string"}, "n": {"type": "array", "items": item}}}), ("r", "PUT", "/b"): k, ("s", "PUT", "/c"): k}


def test_bodies_in_openapi(spark):
    codes = "struct<response:struct<status_codes:array<int>>>"
    endpoints = spark.createDataFrame([("e1", "exposed", "POST", "/a/{x}", (((201, 400),),)), ("e2", "exposed", "PUT", "/b", ((None,),))], f"endpoint_id string, direction string, method string, path string, contract {codes}")
    bodies = spark.createDataFrame([("POST", "/a/{x}", "application/json", '{"type":"object"}')], "method string, path string, content_type string, schema string")
    shown = [r.line for r in render.openapi_lines(endpoints, bodies).orderBy("section", "position").collect()]
    assert '      requestBody: {content: {"application/json": {schema: {"type":"object"}}}}' in shown and sum("requestBody" in x for x in shown) == 1
    assert '      responses: {"201": {description: shown}, "400": {description: shown}, default: {description: not demonstrated}}' in shown and "      responses: {default: {description: not demonstrated}}" in shown


def test_fields_are_dealt_by_owner_once(spark, monkeypatch):
    """The number of tasks grows with the fields, and one shuffle serves all levels; names that need escapes keep them."""
    monkeypatch.setattr(enrichment, "FIELDS", 2)
    rows = [("r", str(k), "POST", "request_field", name, '{"type":"string","required":true}', 1) for k in range(3) for name in ("a.[].b.c", 'q"\\\n~', "a.é")]
    found = enrichment.body_schemas(spark.createDataFrame(rows, "repository_id string, owner string, method string, kind string, name string, value string, line int"))
    text = {"type": "string"}
    c = {"type": "object", "properties": {"c": text}, "required": ["c"]}
    item = {"type": "object", "properties": {"b": c}}
    want = {"type": "object", "properties": {"a": {"type": "array", "items": item, "properties": {"é": text}, "required": ["é"]}, 'q"\\\n~': text}, "required": ['q"\\\n~']}
    assert [json.loads(r.schema) for r in found.collect()] == [want] * 3
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and ", 5), REPARTITION_BY_NUM" in plan
