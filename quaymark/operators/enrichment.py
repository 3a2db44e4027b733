"""What a Slim route's body says about its contract and behaviour.

Bodies are cut out file by file in Arrow batches; each gives fact rows (kind, name, value, line).
Facts of helper functions reach routes over the calls between them, with Spark joins
(``operators.reach``). What cannot be read is an ``unresolved`` fact, never a guess.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.frames import cut, dealt
from quaymark.functions.text import literal, mask_code, matching, split_top, statements
from quaymark.operators.reach import reachable
from quaymark.operators.spans import innermost_scope

FACTS = "repository_id string, path string, owner string, method string, endpoint string, kind string, name string, value string, line int"
#: Beginnings of the codes of open facts in this file, as users of its reports know them.
OPEN_CODES = ("slim_php_request_", "slim_php_response_", "slim_php_security_", "slim_php_semantic_")
Fact = tuple[str, str | None, str | None, int]  # kind, name, value, offset in the body

_ROUTE = re.compile(r"(?<![\w$])\$\w+\s*->\s*(get|post|put|patch|delete|options)\s*\(", re.IGNORECASE)
_FUNCTION = re.compile(r"\bfunction\s+(\w+)\s*\(")
_KEYS = re.compile(r"\s*\[\s*(?:['\"]([\w-]+)['\"]|(\d+|\$\w+))\s*\]")
_CASTS = {"int": "integer", "integer": "integer", "float": "number", "double": "number", "bool": "boolean", "boolean": "boolean", "string": "string", "array": "array"}


def bodies(code: str) -> Iterator[tuple[str, str | None, str | None, int, int, str]]:
    """(owner, method, endpoint, start, end, what follows) of routes with a literal path and of named functions."""
    for call in _ROUTE.finditer(code):
        end = matching(code, call.end() - 1)
        arguments = split_top(code[call.end() : end]) if end > 0 else []
        url = literal(arguments[0]) if arguments else None
        start = code.find("{", code.find("function", call.end(), max(end, 0)))
        if url is not None and len(arguments) > 1 and 0 < start < end and "function" in arguments[1]:
            close = matching(code, start)
            tail = code[end + 1 : code.find(";", end) if code.find(";", end) > 0 else len(code)]
            yield f"{call[1].upper()} {url}", call[1].upper(), url, start + 1, close if close > 0 else end, tail
    for call in _FUNCTION.finditer(code):
        close = matching(code, call.end() - 1)
        start = code.find("{", close)
        if close > 0 and start > 0 and not code[close + 1 : start].strip(" \t\r\n:?|\\" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            end = matching(code, start)
            if end > 0:
                yield call[1], None, None, start + 1, end, code[call.end() : close]


def key_path(text: str, at: int) -> tuple[list[str], int]:
    """Keys of ``[...]`` accesses from a place on; an index or a variable counts as one of many (``[]``)."""
    keys = []
    while found := _KEYS.match(text, at):
        keys.append(found[1] if found[1] is not None else "[]")
        at = found.end()
    return keys, at


def request_facts(body: str) -> Iterator[Fact]:
    """Fields read from the parsed body, uploads and query parameters, and what of the body is handed to local functions."""
    roots = {m[1]: [] for m in re.finditer(r"(\$\w+)\s*=\s*(?:\([\w\s]+\)\s*)?(?:\$\w+->getParsedBody\(\)|json_decode\s*\([^;]*?(?:getBody\(\)|php://input)[^;]*\))", body)}
    bound = bind(body, roots)
    yield from field_facts(body, bound)
    for m in re.finditer(r"(?<![\w>$:\\])([A-Za-z_]\w*)\s*\(", body):
        end = matching(body, m.end() - 1)
        for k, argument in enumerate(split_top(body[m.end() : end]) if end > 0 else []):
            name = re.match(r"\$\w+", argument)
            keys, stop = key_path(argument, name.end()) if name else ([], 0)
            if name and name[0] in bound and stop == len(argument):
                yield "body_argument", m[1], json.dumps({"position": k, "under": ".".join([*bound[name[0]], *keys])}), m.start()
    yield from other_request_facts(body)


def parameter_facts(parameters: str, body: str) -> Iterator[Fact]:
    """Fields that a function reads from each of its parameters, which may be handed a request's body."""
    for k, parameter in enumerate(split_top(parameters)):
        name = re.search(r"\$\w+", parameter)
        for kind, field, value, at in field_facts(body, bind(body, {name[0]: []})) if name else ():
            if kind == "request_field":
                yield "parameter_field", field, json.dumps(json.loads(value) | {"position": k}), at


def bind(body: str, roots: dict[str, list[str]]) -> dict[str, list[str]]:
    """Variables that hold a part of the roots, over aliases and ``foreach`` until nothing new is bound."""
    roots = dict(roots)
    while True:
        new = {}
        for m in re.finditer(r"(\$\w+)\s*=\s*(\$\w+)((?:\s*\[[^\]]+\])+)\s*(?:\?\?[^;]*)?;", body):
            if m[2] in roots and m[1] not in roots:
                new[m[1]] = roots[m[2]] + key_path(m[3], 0)[0]
        for m in re.finditer(r"foreach\s*\(\s*(\$\w+)((?:\s*\[[^\]]+\])*)\s+as\s+(?:\$\w+\s*=>\s*)?(\$\w+)", body):
            if m[1] in roots and m[3] not in roots:
                new[m[3]] = [*roots[m[1]], *key_path(m[2], 0)[0], "[]"]
        if not new:
            return roots
        roots |= new


def field_facts(body: str, bound: dict[str, list[str]]) -> Iterator[Fact]:
    """Fields read from variables that hold a part of a request."""
    for name, above in bound.items():
        for m in re.finditer(re.escape(name) + r"(?=\s*\[)", body):
            keys, end = key_path(body, m.end())
            if not keys:
                yield "unresolved", "slim_php_request_body_dynamic", body[m.start() : body.find(";", m.start()) if ";" in body[m.start() :] else len(body)], m.start()
                continue
            before, after = body[: m.start()].rstrip(), body[end : end + 40]
            cast = re.search(r"\((\w+)\)$", before)
            optional = after.lstrip().startswith("??") or re.search(r"(?:isset|empty|array_key_exists)\s*\($", before)
            yield "request_field", ".".join([*above, *keys]), json.dumps({"type": _CASTS.get(cast[1].lower()) if cast else None, "required": False if optional else None}), m.start()


def other_request_facts(body: str) -> Iterator[Fact]:
    """Multipart fields and query parameters."""
    files = {m[1] for m in re.finditer(r"(\$\w+)\s*=\s*\$\w+->getUploadedFiles\(\)", body)}
    for name in files:
        for m in re.finditer(re.escape(name) + r"\s*\[\s*['\"]([\w-]+)['\"]\s*\]", body):
            yield "multipart_field", m[1], None, m.start()
    for m in re.finditer(r"->getQueryParams\(\)\s*\[\s*['\"]([\w-]+)['\"]", body):
        yield "query_parameter", m[1], None, m.start()


def response_facts(body: str) -> Iterator[Fact]:
    """Fields of array literals sent as JSON, and literal statuses."""
    arrays = {m[1]: body[m.end() - 1 : matching(body, m.end() - 1) + 1] for m in re.finditer(r"(\$\w+)\s*=\s*\[", body)}
    for m in re.finditer(r"(?:->withJson|\bjson_encode)\s*\(", body):
        end = matching(body, m.end() - 1)
        arguments = split_top(body[m.end() : end]) if end > 0 else []
        sent = arrays.get(arguments[0], arguments[0]) if arguments else ""
        if not sent.startswith("["):
            yield "unresolved", "slim_php_response_json_dynamic", sent, m.start()
            continue
        for item in split_top(sent[1:-1]):
            key = literal(item.split("=>", 1)[0]) if "=>" in item else None
            if key is None:
                yield "unresolved", "slim_php_response_json_unresolved", item, m.start()
            else:
                value = item.split("=>", 1)[1].strip()
                kind = "string" if literal(value) is not None else "integer" if re.fullmatch(r"-?\d+", value) else "boolean" if value.lower() in ("true", "false") else None
                yield "response_field", key, kind, m.start()
        if len(arguments) > 1 and arguments[1].isdigit():
            yield "status_code", arguments[1], None, m.start()
    for m in re.finditer(r"->withStatus\s*\(\s*(\d{3})\s*[,)]", body):
        yield "status_code", m[1], None, m.start()


def security_facts(body: str, tail: str) -> Iterator[Fact]:
    """How a route authenticates: in its body, or by a middleware added to it."""
    header = re.search(r"getHeader(?:Line)?\s*\(\s*['\"]Authorization['\"]", body)
    decode = re.search(r"\bJWT\s*::\s*decode\s*\(", body)
    if header and decode:
        yield "authentication", "jwt", "bearer" if re.search(r"Bearer", body) else "raw", header.start()
    elif header:
        yield "unresolved", "slim_php_security_unresolved", "authorization header", header.start()
    for m in re.finditer(r"->\s*add\s*\(\s*(?:new\s+)?([\w\\:$]+)", tail):
        yield "middleware", m[1], None, len(body)


def guards(code: str) -> Iterator[tuple[str, str | None, int, int]]:
    """(class, how its methods read credentials, start, end) of the classes of a file, which may be middleware; None where they read none."""
    for c in re.finditer(r"\bclass\s+(\w+)[^{;]*\{", code):
        end = matching(code, c.end() - 1)
        body = code[c.end() : end] if end > 0 else ""
        reads = re.search(r"getHeader(?:Line)?\s*\(\s*['\"]Authorization['\"]", body) and re.search(r"\bJWT\s*::\s*decode\s*\(", body)
        yield c[1], ("bearer" if "Bearer" in body else "raw") if reads else None, c.start(), end


def semantic_facts(body: str) -> Iterator[Fact]:
    """Data access, side effects, claims, conditions, outbound calls, local calls and what blocks a full reading."""
    texts: dict[str, str] = {}
    for s in statements(body):
        m = re.match(r"\s*(\$\w+)\s*(\.?=)\s*(.+)$", s, re.DOTALL)
        if m and (literal(m[3]) is not None or re.match(r"['\"]", m[3])):
            parts = [literal(p) if literal(p) is not None else "{?}" for p in split_top(m[3], ".")]
            texts[m[1]] = (texts.get(m[1], "") if m[2] == ".=" else "") + "".join(parts)
    for m in re.finditer(r"->\s*(query|prepare|exec)\s*\(", body):
        end = matching(body, m.end() - 1)
        argument = split_top(body[m.end() : end])[0] if end > m.end() else ""
        sql = texts.get(argument) or literal(argument)
        if sql is None:
            yield "unresolved", "slim_php_semantic_dynamic_sql", argument, m.start()
            continue
        found = False
        for verb, target in re.findall(r"\b(FROM|JOIN|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CALL)\s+[`\"]?([\w.]+)", sql, re.IGNORECASE):
            verb = verb.upper().split()[0]
            found = True
            yield "data_access", target, "read" if verb in ("FROM", "JOIN") and not re.match(r"\s*DELETE", sql, re.IGNORECASE) else "write", m.start()
        if not found or "{?}" in sql:
            yield "unresolved", "slim_php_semantic_sql_target_unresolved" if not found else "slim_php_semantic_sql_dynamic_expression", sql, m.start()
    claims = {m[1] for m in re.finditer(r"(\$\w+)\s*=\s*(?:\(array\)\s*)?JWT\s*::\s*decode\s*\(", body)}
    while more := {m[1] for m in re.finditer(r"(\$\w+)\s*=\s*(?:\(array\)\s*)?(\$\w+)(?:->data)?\s*;", body) if m[2] in claims} - claims:
        claims |= more
    for name in claims:
        for m in re.finditer(re.escape(name) + r"(?:->(\w+)|\[['\"](\w+)['\"]\])", body):
            yield "claim_consumed", m[1] or m[2], None, m.start()
    for m in re.finditer(r"\bJWT\s*::\s*encode\s*\(\s*(\[|\$\w+)", body):
        inner = body[m.end() - 1 : matching(body, m.end() - 1) + 1] if m[1] == "[" else next((body[a.end() - 1 : matching(body, a.end() - 1) + 1] for a in re.finditer(re.escape(m[1]) + r"\s*=\s*\[", body)), "")
        if not inner:
            yield "unresolved", "slim_php_semantic_jwt_encode_unparsed", m[1], m.start()
        for item in split_top(inner[1:-1]):
            key = literal(item.split("=>", 1)[0]) if "=>" in item else None
            if key:
                yield "claim_produced", key, None, m.start()
    for m in re.finditer(r"\bif\s*\(", body):
        close = matching(body, m.end() - 1)
        start = body.find("{", close)
        inner = body[start + 1 : matching(body, start)] if close > 0 and start > 0 and not body[close + 1 : start].strip() else ""
        status = re.search(r"(?:withStatus|withJson)\s*\((?:[^;]*,)?\s*(\d{3})\s*\)", inner)
        yield "condition", re.sub(r"\s+", " ", body[m.end() : close]), status[1] if status else None, m.start()
        if re.search(r"\bif\s*\(|\bswitch\s*\(", inner):
            yield "unresolved", "slim_php_semantic_nested_condition_branch", None, m.start()
    for pattern, kind in ((r"\bcurl_init\s*\(\s*([^)]*)\)", "outbound_http"), (r"\bnew\s+\\?SoapClient\s*\(\s*([^,)]*)", "outbound_soap"), (r"\b(?:file_put_contents|fwrite)\s*\(\s*([^,)]*)", "file_write"), (r"\bmail\s*\(\s*([^,)]*)", "mail")):
        for m in re.finditer(pattern, body):
            target = literal(m[1]) or texts.get(m[1].strip())
            yield (kind, target, None, m.start()) if target else ("unresolved", "slim_php_semantic_outbound_target_unresolved", kind, m.start())
    for pattern, code in ((r"(?<![\w>$:])\$\w+\s*\(", "slim_php_semantic_dynamic_function_call"), (r"->\s*\$\w+\s*\(", "slim_php_semantic_dynamic_method_call"), (r"\bnew\s+\$\w+", "slim_php_semantic_dynamic_class"), (r"\bswitch\s*\(", "slim_php_semantic_switch_control_flow"), (r"\bcall_user_func(?:_array)?\s*\(", "slim_php_semantic_dynamic_callback")):
        for m in re.finditer(pattern, body):
            yield "unresolved", code, body[m.start() : body.find(";", m.start()) if ";" in body[m.start() :] else len(body)], m.start()
    for m in re.finditer(r"(?<![\w>$:\\])(?!(?:if|for|foreach|while|switch|function|array|isset|empty|return|list|catch|json_encode|json_decode|mail|fwrite)\b)([A-Za-z_]\w*)\s*\(", body):
        yield "call", m[1], None, m.start()


def facts(files: DataFrame) -> DataFrame:
    """All facts of PHP files (repository_id, path, text); functions have no method."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for repository, path, text in zip(frame["repository_id"], frame["path"], frame["text"], strict=True):
                code = mask_code(text, hash_comments=True)
                ends = [m.start() for m in re.finditer("\n", code)]
                out += [(repository, path, name, None, None, "guard", name, how, bisect_right(ends, at - 1) + 1) for name, how, at, _ in guards(code)]
                for owner, method, endpoint, lo, hi, tail in bodies(code):
                    body = code[lo:hi]
                    asked = request_facts(body) if method else parameter_facts(tail, body)
                    found = [("owner", owner, str(bisect_right(ends, hi - 1) + 1), 0), *asked, *response_facts(body), *security_facts(body, tail if method else ""), *semantic_facts(body)]
                    out += [(repository, path, owner, method, endpoint, kind, name, value, bisect_right(ends, lo + at - 1) + 1) for kind, name, value, at in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")])

    php = files.where(F.lower("path").endswith(".php") & F.col("text").isNotNull() & (F.col("text").contains("->") | F.col("text").contains("function")))
    return guarded(handed_on(cut(php.select("repository_id", "path", "text").mapInPandas(run, FACTS))))


def laid_onto_routes(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Facts with the integration calls (repository_id, path, line, operation, target) that stand inside of a route's body.

    A call belongs to the innermost scope around its line; what stands in a named function is that function's.
    """
    scope = F.to_json(F.struct("owner", "method", "endpoint"))
    spans = found.where("kind = 'owner'").select("repository_id", "path", F.col("line").cast("bigint").alias("lo"), (F.col("value").cast("bigint") + 1).alias("hi"), scope.alias("scope")).dropDuplicates(["repository_id", "path", "lo", "hi"])
    points = cut(calls.withColumn("id", F.monotonically_increasing_id()))
    inside = innermost_scope(points.select("repository_id", "path", "id", F.col("line").cast("bigint").alias("line")), spans, ["repository_id", "path"], "id", "line", "lo", "hi", "scope").where("scope IS NOT NULL")
    part = lambda name: F.get_json_object("scope", f"$.{name}").alias(name)
    laid = points.join(inside, "id").select("repository_id", "path", part("owner"), part("method"), part("endpoint"), F.lit("outbound_soap").alias("kind"), F.col("operation").alias("name"), F.col("target").alias("value"), F.col("line").cast("int").alias("line"))
    return found.unionByName(laid.select(*found.columns)).distinct()


def guarded(found: DataFrame) -> DataFrame:
    """Facts with the authentication that a route's middleware asks for, by the class of that name in its repository.

    A class that reads no credentials, is defined several times, or is not there leaves the route's security open. A route
    that authenticates in its own body needs no middleware for that.
    """
    route = ["repository_id", "path", "owner", "method", "endpoint"]
    own = found.where("kind = 'authentication' AND method IS NOT NULL").select(*route).distinct()
    classes = found.where("kind = 'guard'").groupBy("repository_id", F.col("name").alias("class")).agg(F.count("*").alias("n"), F.min("value").alias("how"))
    added = found.where("kind = 'middleware' AND method IS NOT NULL").join(own, route, "left_anti").withColumn("class", F.regexp_extract("name", r"(\w+)(?:::class)?$", 1))
    known = F.coalesce((F.col("n") == 1) & F.col("how").isNotNull(), F.lit(False))
    told = added.join(classes, ["repository_id", "class"], "left").withColumn("value", F.when(known, F.col("how")).otherwise(F.col("name")))
    told = told.withColumn("kind", F.when(known, "authentication").otherwise("unresolved")).withColumn("name", F.when(known, "jwt").otherwise("slim_php_security_middleware_unresolved"))
    return found.where("kind <> 'guard'").unionByName(told.select(*found.columns))


def handed_on(found: DataFrame) -> DataFrame:
    """Facts with the request fields that local functions read from a body handed to them, by position, over one call.

    A function defined several times in its repository is not followed; the call is an ``unresolved`` fact.
    """
    place = lambda c: F.get_json_object(c, "$.position").cast("int")
    sent = found.where("kind = 'body_argument'").select("repository_id", "path", "owner", "method", "endpoint", "line", F.col("name").alias("function"), place("value").alias("position"), F.get_json_object("value", "$.under").alias("under"))
    functions = found.where("method IS NULL AND kind = 'owner'").groupBy("repository_id", F.col("owner").alias("function")).agg(F.count("*").alias("n"))
    calls = sent.join(functions, ["repository_id", "function"])
    read = found.where("kind = 'parameter_field'").select("repository_id", F.col("owner").alias("function"), place("value").alias("position"), "name", "value").distinct()
    fields = calls.where("n = 1").join(read, ["repository_id", "function", "position"])
    whole = F.when(F.col("under") == "", F.col("name")).otherwise(F.concat_ws(".", "under", "name"))
    value = F.to_json(F.struct(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.required").cast("boolean").alias("required")), {"ignoreNullFields": "false"})
    columns = [F.col(c) for c in ("repository_id", "path", "owner", "method", "endpoint")]
    gained = fields.select(*columns, F.lit("request_field").alias("kind"), whole.alias("name"), value.alias("value"), "line")
    several = calls.where("n > 1").select(*columns, F.lit("unresolved").alias("kind"), F.lit("slim_php_request_function_ambiguous").alias("name"), F.col("function").alias("value"), "line")
    rest = found.where("kind NOT IN ('body_argument', 'parameter_field')")
    return rest.unionByName(gained).unionByName(several).distinct()


def behaviour(found: DataFrame, depth: int = 4) -> DataFrame:
    """(repository_id, endpoint owner, kind, name, value) of routes, with those of helpers within reach.

    Only functions defined once in a repository are followed; calls to others defined several times
    give an ``unresolved`` fact, and so do helpers beyond ``depth`` and helpers that call themselves,
    over others or not.
    """
    own = found.where("method IS NOT NULL")
    functions = found.where("method IS NULL AND kind = 'owner'").groupBy("repository_id", "owner").agg(F.count("*").alias("n"))
    key = lambda c: F.concat_ws("\u0001", "repository_id", c)
    single = functions.where("n = 1").select(key("owner").alias("callee"))
    calls = found.where("kind = 'call'").select(key("owner").alias("caller"), key("name").alias("callee")).distinct()
    roots = own.where("kind = 'owner'").select(key("owner").alias("root")).distinct()
    followed = calls.join(single, "callee", "left_semi").select("caller", "callee")
    fronts = reachable(roots, followed, depth)
    reached = fronts.where("depth > 0").select("root", "node")
    beyond = fronts.where(F.col("depth") == depth).join(followed, F.col("node") == F.col("caller")).select("root", F.col("callee").alias("node")).join(fronts, ["root", "node"], "left_anti")
    # A helper that reaches a caller of its own stands on a cycle.
    around = reachable(single.select(F.col("callee").alias("root")), followed, depth).join(followed, F.col("node") == F.col("caller")).where("callee = root").select(F.col("root").alias("node")).distinct()
    issue = lambda rows, name: rows.select("root", F.lit("unresolved").alias("kind"), F.lit(name).alias("name"), F.substring_index("node", "\u0001", -1).alias("value"))
    limits = issue(beyond, "slim_php_semantic_helper_depth_limit").unionByName(issue(reached.join(around, "node", "left_semi"), "slim_php_semantic_helper_cycle"))
    inherited = found.where("method IS NULL AND kind NOT IN ('owner', 'call', 'request_field')").select(key("owner").alias("node"), "kind", "name", "value")
    several = calls.join(functions.where("n > 1").select(key("owner").alias("callee")), "callee", "left_semi")
    ambiguous = several.join(roots, several.caller == roots.root).select("root", F.lit("unresolved").alias("kind"), F.lit("slim_php_semantic_helper_ambiguous").alias("name"), F.substring_index("callee", "\u0001", -1).alias("value"))
    direct = own.where("kind NOT IN ('owner', 'call')").select(key("owner").alias("root"), "kind", "name", "value")
    all_ = direct.unionByName(reached.join(inherited, "node").select("root", "kind", "name", "value")).unionByName(ambiguous).unionByName(limits).distinct()
    return all_.select(F.substring_index("root", "\u0001", 1).alias("repository_id"), F.substring_index("root", "\u0001", -1).alias("owner"), "kind", "name", "value")


#: What the codes of open facts say about a caller's view, and codes of what stays inside.
EXTERNAL_MARKS = ("condition", "outbound", "response", "side_effect", "status")
INTERNAL_CODES = ("slim_php_semantic_sql_call_unparsed", "slim_php_semantic_dynamic_sql", "slim_php_semantic_sql_target_unresolved", "slim_php_semantic_sql_dynamic_expression")


def semantic_status(rows: DataFrame) -> DataFrame:
    """Each route: complete without open facts, partial with some, unresolved with nothing else known.

    ``materiality`` tells whether what is open about its behaviour may be seen from outside (``external``), is about data access
    only (``internal``), or neither is known.
    """
    known, open_ = F.count_if(F.col("kind") != "unresolved"), F.count_if(F.col("kind") == "unresolved")
    code = F.when((F.col("kind") == "unresolved") & F.col("name").contains("_semantic_"), F.col("name"))
    seen, inside = F.bool_or(code.rlike("|".join(EXTERNAL_MARKS))), F.bool_and(code.isin(*INTERNAL_CODES))
    told = rows.groupBy("repository_id", "owner").agg(known.alias("facts"), open_.alias("open"), F.coalesce(seen, F.lit(False)).alias("seen"), F.coalesce(inside, F.lit(False)).alias("inside"))
    status = F.when(F.col("open") == 0, "complete").when(F.col("facts") > 0, "partial").otherwise("unresolved")
    return told.withColumn("status", status).withColumn("materiality", F.when(F.col("seen"), "external").when(F.col("inside"), "internal").otherwise("unknown")).drop("seen", "inside")


def _quoted(text: Column) -> Column:
    """A JSON string; printable ASCII without quotes and backslashes needs no escapes."""
    whole = F.to_json(F.array(text))
    return F.when(text.rlike(r"[^ !#-\[\]-~]"), whole.substr(F.lit(2), F.length(whole) - 2)).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


#: Fields of bodies in one task.
FIELDS = 200_000


def body_schemas(found: DataFrame) -> DataFrame:
    """(repository_id, owner, schema as canonical JSON) of each route's request fields.

    The fields' dotted paths are a tree, which is folded from its deepest level up: one aggregation by parent a
    level, which makes a node's JSON of its children's; what stands higher is a group of its own. An owner's schema is one row, so
    its fields are dealt by owner once, and no level is shuffled. Required names are united; of a field that is read several
    times the first type and requiredness by line count; what has items is an array, and what has properties an
    object, unless a type was read before.
    """
    at = F.struct("line", "name")
    first = lambda value: F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), at))
    kind, need = F.get_json_object("value", "$.type"), F.get_json_object("value", "$.required").cast("boolean")
    fields = found.where("method IS NOT NULL AND kind = 'request_field'").select("repository_id", "owner", "name", "line", kind.alias("t"), need.alias("r"))
    node = ["repository_id", "owner", "depth", "p"]
    leaf = fields.groupBy("repository_id", "owner", "name").agg(first(F.col("t")).alias("type"), first(F.col("r")).alias("required"), F.min(F.when(F.col("t").isNotNull(), at)).alias("typed"), F.min(at).alias("seen"))
    nothing = {"key": "string", "json": "string", "kept": "boolean", "below": leaf.schema["seen"].dataType.simpleString()}
    leaf = cut(leaf.where("name IS NOT NULL").withColumn("depth", F.size(F.split("name", r"\.", -1))).withColumnRenamed("name", "p"))
    told = leaf.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d"), F.count(F.lit(1)).alias("n")).first()
    rows = dealt(leaf, told.n, FIELDS, "repository_id", "owner").select("*", *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()])
    for d in range(told.d, -1, -1):
        named = F.col("key").isNotNull() & (F.col("key") != "[]")
        # Names are single, and below the deepest level there is nothing to gather.
        texts = F.array().cast("array<string>")
        nodes = rows.withColumns({"any": F.col("below"), "kids": texts, "items": F.col("json"), "names": texts}) if d == told.d > 0 else rows.groupBy(*node).agg(
            F.max("type").alias("type"), F.max("required").alias("required"), F.min("typed").alias("typed"), F.min("seen").alias("seen"), F.min(F.when(named, F.col("below"))).alias("below"), F.min("below").alias("any"),
            F.array_sort(F.collect_list(F.when(named, F.concat(_quoted(F.col("key")), F.lit(":"), F.col("json"))))).alias("kids"), F.max(F.when(F.col("key") == "[]", F.col("json"))).alias("items"),
            F.array_sort(F.collect_set(F.when(named & F.col("kept"), _quoted(F.col("key"))))).alias("names"),
        )
        mine = F.lit("object") if d == 0 else F.when(F.col("below").isNull() | (F.col("typed") < F.col("below")), F.col("type"))
        said = F.when(F.col("items").isNotNull(), "array").otherwise(F.coalesce(mine, F.when(F.size("kids") > 0, "object")))
        parts = F.array_compact(F.array(
            F.concat(F.lit('"items":'), F.col("items")), F.when(F.size("kids") > 0, F.concat(F.lit('"properties":{'), F.array_join("kids", ","), F.lit("}"))),
            F.when(F.size("names") > 0, F.concat(F.lit('"required":['), F.array_join("names", ","), F.lit("]"))), F.when(said.isNotNull(), F.concat(F.lit('"type":'), _quoted(said))),
        ))
        json_ = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
        if d == 0:
            return nodes.select("repository_id", "owner", json_.alias("schema"))
        here, key = F.col("depth") == d, F.substring_index("p", ".", -1)
        above = F.lit("") if d == 1 else F.left("p", F.length("p") - F.length(key) - 1)
        up = {"key": key, "json": json_, "kept": F.col("required"), "below": F.least("seen", "any")}
        rows = nodes.select(
            "repository_id", "owner", F.when(here, d - 1).otherwise(F.col("depth")).alias("depth"), F.when(here, above).otherwise(F.col("p")).alias("p"),
            *[F.when(~here, F.col(c)).alias(c) for c in ("type", "required", "typed", "seen")], *[F.when(here, x).alias(c) for c, x in up.items()],
        )


def route_bodies(found: DataFrame) -> DataFrame:
    """(repository_id, method, path, content_type, schema) of routes that read a body: its fields' schema, uploads among them as strings.

    Several bodies of one method and path that agree are one; where they differ, which one is served is not shown, and there is no row.
    """
    upload = F.col("kind") == "multipart_field"
    fields = found.where(upload | (F.col("kind") == "request_field")).withColumn("value", F.when(upload, F.lit('{"type":"string"}')).otherwise(F.col("value")))
    schemas = body_schemas(fields.withColumn("kind", F.lit("request_field")))
    own = found.where("method IS NOT NULL").groupBy("repository_id", "owner", "method", F.col("endpoint").alias("path")).agg(F.bool_or(F.coalesce(upload, F.lit(False))).alias("u"))
    own = own.withColumn("content_type", F.when(F.col("u"), "multipart/form-data").otherwise("application/json")).join(schemas, ["repository_id", "owner"])
    return own.groupBy("repository_id", "method", "path").agg(F.count_distinct("content_type", "schema").alias("n"), F.min("content_type").alias("content_type"), F.min("schema").alias("schema")).where("n = 1").drop("n")


def enrichment_status(rows: Column, open_rows: Column) -> Column:
    """``enriched``, ``partial`` or ``pending`` by how much was read."""
    return F.when(rows == 0, "pending").when(open_rows > 0, "partial").otherwise("enriched")
