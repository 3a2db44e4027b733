"""JSON documents: compiled schemas, tree digests, and what is read back."""

import json

import pytest
from pyspark.sql import functions as F

from quaymark.functions import trees
from quaymark.operators import schema_rules
from quaymark.operators.validation import Invalid
from quaymark.sources import documents

SCHEMA = {
    "$defs": {"word": {"type": "string", "minLength": 2, "pattern": "^[a-zé]"}, "tree": {"type": "object", "properties": {"leaf": {"$ref": "#/$defs/word"}}, "additionalProperties": {"type": "array", "items": {"$ref": "#/$defs/word"}, "minItems": 1}}},
    "type": "object", "required": ["n", "at"], "properties": {"n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "at": {"type": "string", "format": "date-time"}, "t": {"$ref": "#/$defs/tree"}, "c": {"const": {"b": [1, "é"], "a": None}}, "e": {"enum": [1, "1", True, None]}},
    "additionalProperties": False,
}


@pytest.mark.parametrize(("text", "found"), [
    ('{"n":1,"at":"2024-01-02T03:04:05Z"}', []), ('{"n":null,"at":"2024-01-02T03:04:05+02:00","e":true}', []), ('{"n":2.0,"at":"2024-01-02T03:04:05Z","e":1}', []), ("nope", [("$", "json")]), ('{"n":1,"n":2}', [("$", "json")]), ("[1]", [("$", "type")]), (None, []),
    ('{"n":0,"at":"2024-01-02"}', [("$.n", "minimum"), ("$.at", "date-time")]), ('{"n":1.5,"x":1}', [("$.n", "type"), ("$.at", "required"), ("$.x", "additionalProperties")]), ('{"n":10,"at":7,"e":false}', [("$.n", "maximum"), ("$.at", "type"), ("$.e", "enum")]),
    ('{"n":1,"at":"2024-01-02T03:04:05Z","c":{"a":null,"b":[1,"é"]},"t":{"leaf":"é1","k":["ab","B2",3],"q":[]}}', [("$.t.k[1]", "pattern"), ("$.t.k[2]", "type"), ("$.t.q", "minItems")]),
    ('{"n":1,"at":"2024-13-02T03:04:05Z","c":{"b":[1,"e"],"a":null},"t":{"leaf":"a","k":{}}}', [("$.at", "date-time"), ("$.c", "const"), ("$.t.leaf", "minLength"), ("$.t.k", "type")]),
])
def test_compiled_schema(spark, text, found):
    rows = schema_rules.document_violations(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", SCHEMA)
    assert sorted((r.path, r.rule) for r in rows.collect()) == sorted(found)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("schema", [{"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"x": {"$ref": "#/$defs/a"}}}}}, {"$ref": "#/$defs/b"}, {"$ref": "http://x"}, {"type": "word"}, {"oneOf": []}, {"items": {"$ref": 3}}])
def test_wrong_schemas_are_refused(schema):
    with pytest.raises(schema_rules.SchemaError):
        schema_rules.compiled(schema)


def digest_groups(spark, texts):
    rows = trees.document_digests(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()
    assert len(rows) == len(texts)
    by = {r.k: r.digest for r in rows}
    return [by[k] for k in range(len(texts))]


def test_digests_of_equal_artifacts(spark):
    a = '{"a":{"fields":["x","y",{"q":[1,2]}],"list":[[1],[2]],"e":{}},"generated_at":1,"z":"p\\"{["}'
    same = ['{ "z":"p\\u0022{[","audit_id":{"k":[]}, "a":{"e":{"dirty":true},"list":[[1],[2]],"fields":[{"q":[1,2]},"y","x"]}}', a]
    other = [a.replace("[[1],[2]]", "[[2],[1]]"), a.replace("[1,2]", "[2,1]"), a.replace('"x","y"', '"x","y","y"'), a.replace('"x"', '"w"'), a.replace('"e":{}', '"e":[]'), a.replace('"e":{}', '"e":null'), a.replace(',"e":{}', ""), a.replace('"z"', '"zz"'), "[]", "{}", '"s"', "1", "null"]
    found = digest_groups(spark, [a, *same, *other, "not json", None, '{"a":1', ""])
    assert found[0] == found[1] == found[2] and len(set(found[2:-4])) == len(other) + 1
    assert found[-4:] == [None] * 4


def test_digests_of_nested_sets_keep_their_members_apart(spark):
    found = digest_groups(spark, ['{"fields":[["a","b"],["c"]]}', '{"fields":[["c"],["a","b"]]}', '{"fields":[["a"],["b","c"]]}', '{"fields":[["a","b"],["c"],["c"]]}', '{"fields":[{"k":1},{"k":1}]}', '{"fields":[{"k":1}]}'])
    assert found[0] == found[1] and len(set(found)) == 5


FINDING = {
    "schema_version": "2.0", "repository_id": "r", "source_commit": "abcdef1", "status": "complete", "audit_timestamp": "2024-01-02T03:04:05Z", "notes": ["b", "a"],
    "endpoints": [{"endpoint_id": "e", "direction": "consumed", "method": "GET", "path": "/a", "confidence": "confirmed", "evidence": [{"path": "a.php", "line": 3}]}],
}


def written(tmp_path, *found):
    for k, f in enumerate(found):
        (tmp_path / f"{k}.json").write_text(f if isinstance(f, str) else json.dumps(f, indent=2 if k % 2 else None))
    return [str(tmp_path)]


def test_findings_are_checked_by_their_schema(spark, tmp_path):
    other = FINDING | {"repository_id": "q"}
    rows = documents.endpoints(documents.read_findings(spark, written(tmp_path, FINDING, other, FINDING | {"notes": ["a", "b"]}, json.dumps(FINDING) + "\n" + json.dumps(other) + "\n")))
    assert sorted((r.repository_id, r.path, r.evidence[0].line) for r in rows.collect()) == [("q", "/a", 3), ("r", "/a", 3)]


@pytest.mark.parametrize("change", [{"schema_version": "1.0"}, {"status": "ok"}, {"endpoints": [{"endpoint_id": "e"}]}, {"endpoints": [FINDING["endpoints"][0] | {"evidence": [{"path": "a", "line": 0}]}]}, {"audit_timestamp": "today"}])
def test_findings_that_break_their_schema_are_refused(spark, tmp_path, change):
    with pytest.raises(Invalid):
        documents.read_findings(spark, written(tmp_path, FINDING | change))


@pytest.mark.parametrize("change", [{"source_commit": "1234567"}, {"endpoints": []}])
def test_conflicting_snapshots_are_refused(spark, tmp_path, change):
    with pytest.raises(Invalid, match="different"):
        documents.read_findings(spark, written(tmp_path, FINDING, FINDING | change))


def test_depth(spark):
    rows = spark.createDataFrame([("1",), ('{"a":[{"b":[[]]}],"c":"[[[["}',), ("[]",)], "t string")
    assert [r.d for r in rows.select(trees.depth_of(F.try_parse_json("t")).alias("d")).collect()] == [0, 5, 1]


def test_digests_within_a_row_and_by_levels_agree(spark, monkeypatch):
    """Documents are dealt by their text; only deep ones are broken into rows, and what is deep in volatile keys only equals what is not."""
    deep = "[" * 11 + '{"a":[[1]]}' + "]" * 11
    texts = ['{"a":[1,{"b":null}],"fields":["x",[2,{}]]}', '{"fields":[[2,{}],"x"],"a":[1,{"b":null}]}', '{"a":1,"dirty":' + deep + "}", '{"a":1}', deep, deep.replace("1", "2"), "[]", '{"dirty":1}', "{}", "null", '"{[{[{[{[{["', "{", None, "[{},[]]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    monkeypatch.setattr(trees, "TEXT_OF_TASK", 20)
    told = lambda: {r.k: r.digest for r in trees.document_digests(rows, "k", "t").collect()}
    in_rows = told()
    monkeypatch.setattr(trees, "SHALLOW", 0)
    assert told() == in_rows and len(in_rows) == len(texts)
    monkeypatch.setattr(trees, "SHALLOW", 2)
    assert told() == in_rows
    same = [(j, k) for j in range(len(texts)) for k in range(j) if in_rows[j] is not None and in_rows[j] == in_rows[k]]
    assert same == [(1, 0), (3, 2), (8, 7)] and [k for k, d in in_rows.items() if d is None] == [11, 12]
    monkeypatch.setattr(trees, "SHALLOW", 8)
    shallow = rows.where("k NOT IN (2, 4, 5)")
    found = trees.document_digests(shallow, "k", "t")
    assert found.rdd.getNumPartitions() == -(-sum(len(t or "") for k, t in enumerate(texts) if k not in (2, 4, 5)) // 20)
    assert "Aggregate" not in found._jdf.queryExecution().sparkPlan().toString()
