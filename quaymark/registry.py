"""Queries over the driver's tables: each operator over columns that stand for its own, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import ids, paths, text
from quaymark.operators import compatibility as compat
from quaymark.operators import consumption, correlation, gates, inventory, merging, projection, reach, schema_rules, spans, validation
from quaymark.plans import render

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SHAPE_SQL = r"regexp_replace({}, '\{{[A-Za-z_][A-Za-z0-9_-]*(:[^}}]+)?\}}', '{{}}', 'g')"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _filled(pairs, column: int, key: str) -> str:
    """A SQL CASE over a number that gives one of some texts, with the number in it."""
    cases = " ".join(f"WHEN {k} THEN " + ("NULL" if pair[column] is None else f"replace('{pair[column]}', '<k>', {key}::VARCHAR)") for k, pair in enumerate(pairs))
    return f"CASE {key} % {len(pairs)} {cases} END"


def _chosen(pairs, key: str) -> F.Column:
    """The same with Spark, of the first texts."""
    case = F.lit(None).cast("string")
    for k, pair in enumerate(pairs):
        case = F.when(F.col(key) % len(pairs) == k, F.replace(F.lit(pair[0]), F.lit("<k>"), F.col(key).cast("string"))).otherwise(case)
    return case


# Scalar functions ---------------------------------------------------------------------------------

_TEMPLATED = r"regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/([0-9]+)', '/{item_id:[0-9]+}', 'g')"


def _templated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a path whose numbers are placeholders."""
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1), "/([0-9]+)", r"/{item_id:[0-9]+}")
    return _read(spark, d, "pages").select("page_id", "url", path.alias("path"))


@query(f"SELECT page_id, {SHAPE_SQL.format(_TEMPLATED)} AS shape, len(regexp_extract_all({_TEMPLATED}, '\\{{([A-Za-z_][A-Za-z0-9_-]*)(:[^}}]+)?\\}}', 1))::BIGINT AS n_parameters FROM pages")
def path_shape(spark, d):
    p = _templated_pages(spark, d)
    return p.select("page_id", paths.path_shape(F.col("path")).alias("shape"), F.size(paths.path_parameter_names(F.col("path"))).cast("bigint").alias("n_parameters"))


@query(
    r"SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base, CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END AS path,"
    r" CASE WHEN regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)', 1) <> '' THEN regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)', 1) ELSE url END AS contract_path FROM pages"
)
def url_split(spark, d):
    base, path = paths.split_url(F.col("url"))
    return _read(spark, d, "pages").select("page_id", base.alias("base"), path.alias("path"), paths.contract_path(F.col("url")).alias("contract_path"))


#: Paths (<k> stands for a number) and their canonical form.
_PATHS = (
    ("/shop/{a}/x<k>/{b:[0-9]+}", "/shop/{param1}/x<k>/{param2}"), ("/<k>", "/<k>"), ("{a}{b_c}/{d-e:x{2}<k>", "{param1}{param2}/{param3}<k>"), ("/{1a}/{<k>}/{}", "/{1a}/{<k>}/{}"), ("", ""), ("/{a}/{a}/{_}<k>{", "/{param1}/{param2}/{param3}<k>{"),
)


@query(f"SELECT p_partkey, {_filled(_PATHS, 1, 'p_partkey')} AS canonical FROM part")
def canonical_path(spark, d):
    return _read(spark, d, "part").select("p_partkey", paths.canonical_path(_chosen(_PATHS, "p_partkey")).alias("canonical"))


_PATH = r"regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query(f"""SELECT scope, count(*) AS n FROM (SELECT CASE WHEN ({_PATH} GLOB '/en/*' OR {_PATH} GLOB '/d[ef]/?*') AND NOT ('GET ' || {_PATH} GLOB 'GET */*7*') THEN 'required' ELSE 'excluded' END AS scope FROM pages) GROUP BY scope""")
def scope_partition(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    rows = _read(spark, d, "pages").select(paths.scope(F.col("page_id").cast("string"), F.lit("GET"), path, ("/en/*", "/d[ef]/?*"), ("GET */*7*",)).alias("scope"))
    return rows.groupBy("scope").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, ({_PATH} = '/en' OR starts_with({_PATH}, '/en/') OR {_PATH} = '/fr' OR starts_with({_PATH}, '/fr/')) AS excluded FROM pages")
def exclude_prefix(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/?#]*/?([^?#]*)", 1)
    return _read(spark, d, "pages").select("page_id", paths.excluded(path, ["en/", "fr"]).alias("excluded"))


@query("""SELECT n_nationkey, 'ep_' || left(sha256('unknown-api|exposed|GET|/' || r_name || '/' || n_name), 20) AS endpoint_id,
 'endpoint-' || left(sha256('{"direction":"exposed","method":"GET","path_shape":"/' || n_name || '"}'), 20) AS contract_id
 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def stable_ids(spark, d):
    rows = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"))
    return rows.select(
        "n_nationkey",
        ids.endpoint_id(F.lit(None).cast("string"), F.lit("Exposed "), F.lit("get"), path).alias("endpoint_id"),
        ids.contract_id(F.lit("exposed"), F.lit("get"), F.concat(F.lit("/"), F.col("n_name"))).alias("contract_id"),
    )


#: What a text with a credential (<k> stands for it) shows when that is hidden, by the customer's number.
_CREDENTIALS = (
    ("Authorization: Bearer abc<k> user=n password=pw<k>, url=https://u:<k>@h/x?token=t<k>&k=1", "Authorization: Bearer [REDACTED] user=n password=[REDACTED], url=https://u:[REDACTED]@h/x?token=[REDACTED]&k=1"),
    ('{"q":"password=abc<k>","k":1}', '{"q":"password=[REDACTED]","k":1}'),
    ('{"api_key": "a b, <k>", "password": <k>, "secret": null, "n": [1]}', '{"api_key": "[REDACTED]", "password": "[REDACTED]", "secret": null, "n": [1]}'),
    ("define(''API_KEY'', 1); $apiKey = ''x<k>''; passwordless=1 <k>", "define(''API_KEY'', 1); $apiKey = ''[REDACTED]''; passwordless=1 <k>"),
    ('{\\"client-secret\\":\\"s<k>\\",\\"x\\":\\"authorization: basic <k>==\\"}', '{\\"client-secret\\":\\"[REDACTED]\\",\\"x\\":\\"authorization: basic [REDACTED]\\"}'),
    ("amqp://u:p<k>@h:5672/v and https://h/a?x=1&sig=<k>#f; <k> no secret here", "amqp://u:[REDACTED]@h:5672/v and https://h/a?x=1&sig=[REDACTED]#f; <k> no secret here"),
)


@query(f"SELECT c_custkey, {_filled(_CREDENTIALS, 1, 'c_custkey')} AS shown, (c_custkey % 4 < 2) AS raw_secret FROM customer")
def redaction(spark, d):
    """Assignments, JSON, escaped JSON, headers and URLs; what is hidden already is no secret any more."""
    case = F.replace(_chosen(_CREDENTIALS, "c_custkey"), F.lit("''"), F.lit("'"))
    shown = text.redact(case)
    return _read(spark, d, "customer").select("c_custkey", shown.alias("shown"), text.secret_like(F.when(F.col("c_custkey") % 4 < 2, case).otherwise(shown)).alias("raw_secret"))


@query("SELECT doc_id, CASE WHEN position('ing' IN text) > 0 THEN len(string_split(left(text, position('ing' IN text) - 1), chr(10)))::BIGINT END AS line FROM documents")
def first_match_line(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.first_line_of(F.col("text"), "ing").alias("line"))


@query(r"SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS masked FROM pages")
def comment_mask(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(text.mask_html_comments(F.col("html")).cast("binary")).alias("masked"))


#: JSON texts (<k> stands for a number) and their canonical form; text that is no JSON has none.
_JSON = (
    ('{ "k" : <k>, "id": 7, "a": [1, 2]}', '{"a":[1,2],"id":7,"k":<k>}'),
    ('{"b":{"z":null,"y":[true,{"q":1.5,"p":"é\\n"}]},"a":"<k> \\" x"}', '{"a":"<k> \\" x","b":{"y":[true,{"p":"\\u00e9\\n","q":1.5}],"z":null}}'),
    ("not json <k>", None), (' ["b", "a", <k>, {}, []] ', '["b","a",<k>,{},[]]'), ('"only <k>"', '"only <k>"'), ('{"a":1', None),
)


@query(f"SELECT event_id, {_filled(_JSON, 1, 'event_id')} AS canonical FROM events")
def canonical_json(spark, d):
    return _read(spark, d, "events").select("event_id", ids.canonical_json(_chosen(_JSON, "event_id")).alias("canonical"))


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 6 THEN (props->>'$.k')::INT = user_id % 100 AND event_id % 3 <> 0 END AS equal FROM events""")
def artifact_equal(spark, d):
    """Documents are equal whatever their key order, blanks, volatile keys and the order of sets; text that is no JSON equals nothing."""
    from quaymark.functions import trees

    kind, k = F.col("event_type"), F.col("event_id")
    left = F.concat(F.lit('{"fields":["a",{"b":["'), kind, F.lit('",1]}],"props":'), F.col("props"), F.lit(',"generated_at":"x","list":[1,2]}'))
    list_ = F.when(k % 3 == 0, "[2,1]").otherwise("[1, 2]")
    right = F.concat(F.lit('{"list":'), list_, F.lit(',"props":{"k":'), (F.col("user_id") % 100).cast("string"), F.lit('}, "generated_at":{"y":[]},"fields":[{"b":["'), kind, F.lit('",1]},"a"]'), F.when(k % 7 == 6, "").otherwise("}"))
    rows = _read(spark, d, "events").select("event_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), left.alias("text")), F.struct(F.lit(1).alias("side"), right.alias("text")))).alias("s"))
    rows = rows.select((2 * F.col("event_id") + F.col("s.side")).alias("one"), "s.text")
    told = trees.document_digests(rows, "one", "text")
    both = told.groupBy(F.floor(F.col("one") / 2).cast("bigint").alias("event_id")).agg(F.count("digest").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
    return both.select("event_id", F.when(F.col("n") == 2, F.col("a") == F.col("b")).alias("equal"))


@query("SELECT event_id, event_type || ',k' AS fields, CASE WHEN event_id % 2 = 0 THEN 'k' ELSE '' END AS required, 'integer' AS k_type FROM (SELECT event_id, CASE WHEN event_type < 'k' THEN event_type ELSE 'a_' || event_type END AS event_type FROM events)")
def schema_fields(spark, d):
    name = F.when(F.col("event_type") < "k", F.col("event_type")).otherwise(F.concat(F.lit("a_"), F.col("event_type")))
    need = F.when(F.col("event_id") % 2 == 0, ',"required":["k","k"]').otherwise("")
    schema = F.concat(F.lit('{"properties":{"k":{"type":"integer"},"'), name, F.lit('":{"type":"string"}}'), need, F.lit("}"))
    return _read(spark, d, "events").select(
        "event_id", F.array_join(validation.schema_fields(schema), ",").alias("fields"), F.array_join(validation.schema_required(schema), ",").alias("required"), validation.schema_profile(schema, "k")[0].alias("k_type")
    )


# Extraction ---------------------------------------------------------------------------------------


@query(r"""SELECT page_id, ordinality::BIGINT - 1 AS position, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS ordinality FROM pages)""")
def link_extract(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return _read(spark, d, "pages").select("page_id", F.posexplode(links).alias("position", "href")).withColumn("position", F.col("position").cast("bigint"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<(?:a|p|div)\b'))::BIGINT AS broad, len(regexp_extract_all(html, '<a href="[^"]+"'))::BIGINT AS precise,
 (len(regexp_extract_all(html, '<(?:a|p|div)\b')) - len(regexp_extract_all(html, '<a href="[^"]+"')))::BIGINT AS unresolved FROM pages""")
def broad_minus_precise(spark, d):
    broad, precise = (F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("bigint") for p in (r"<(?:a|p|div)\b", r'<a href="[^"]+"'))
    return _read(spark, d, "pages").select("page_id", broad.alias("broad"), precise.alias("precise"), (broad - precise).alias("unresolved"))


@query("""SELECT n_nationkey, upper(m) AS method, '/' || n_name || '/{id}' AS path FROM nation, (VALUES ('get'), ('post')) v(m)
 UNION ALL SELECT n_nationkey, 'DELETE', '/' || n_name FROM nation""")
def route_extract(spark, d):
    """Endpoints from a generated Laravel file for each nation, by the real extractor."""
    from quaymark.operators.extraction import extract

    code = F.concat(F.lit("<?php\n// Route::get('/commented', 'x');\nRoute::match(['get', 'post'], '/"), F.col("n_name"), F.lit("/:id', 'C@m');\nRoute::delete('/"), F.col("n_name"), F.lit("', 'C@d');\n"))
    files = _read(spark, d, "nation").select(F.lit("r").alias("repository_id"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".php")).alias("path"), code.alias("text"))
    rows = extract(files).where("kind = 'endpoint'")
    return rows.select(F.regexp_extract("path", "^([0-9]+)", 1).cast("int").alias("n_nationkey"), "method", F.col("endpoint").alias("path"))


_SIGNATURES = [("en-article", "language", r"\bthe\b", None), ("de-article", "language", r"\bder\b", None), ("currency", "junk", r"\$\$\$", None), ("table", "layout", r" \| ", None)]


def _signature_rows(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(_SIGNATURES, "name string, kind string, pattern string, extensions array<string>")
    return inventory.detect(_read(spark, d, "documents"), table, "doc_id", "text")


_DETECTED = r"""SELECT doc_id, name, kind FROM documents, (VALUES ('en-article', 'language', '\bthe\b'), ('de-article', 'language', '\bder\b'), ('currency', 'junk', '\$\$\$'), ('table', 'layout', ' \| ')) s(name, kind, pattern) WHERE regexp_matches(text, pattern)"""


@query(_DETECTED)
def signature_detect(spark, d):
    return _signature_rows(spark, d)


@query(f"SELECT kind, name, count(*) AS n, min(doc_id) AS first_doc, CASE WHEN bool_or(doc_id % 3 = 0) THEN 'confirmed' ELSE 'probable' END AS confidence FROM ({_DETECTED}) GROUP BY kind, name")
def detection_merge(spark, d):
    rows = _signature_rows(spark, d).withColumn("confidence", F.when(F.col("doc_id") % 3 == 0, "confirmed").otherwise("probable"))
    merged = inventory.merge_detections(rows, "doc_id")
    return merged.select("kind", "name", "n", F.element_at("evidence", 1).alias("first_doc"), "confidence")


@query("""SELECT p_partkey, name FROM part, (VALUES ('java', 'STEEL', 'contains'), ('dotnet', 'ECONOMY', 'prefix'), ('npm', 'PROMO BRUSHED', 'exact')) k(ecosystem, name, mode)
 WHERE ecosystem = CASE p_partkey % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'dotnet' ELSE 'npm' END
 AND CASE mode WHEN 'exact' THEN replace(p_type, ' ', '.') = name WHEN 'contains' THEN contains(replace(p_type, ' ', '.'), name) ELSE replace(p_type, ' ', '.') = name OR starts_with(replace(p_type, ' ', '.'), name || '.') END""")
def dependency_lookup(spark, d):
    declared = _read(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "java").when(F.col("p_partkey") % 3 == 1, "dotnet").otherwise("npm").alias("ecosystem"), F.translate("p_type", " ", ".").alias("dependency")
    )
    known = spark.createDataFrame([("java", "STEEL", "contains"), ("dotnet", "ECONOMY", "prefix"), ("npm", "PROMO BRUSHED", "exact")], "ecosystem string, name string, mode string")
    return inventory.match_dependencies(declared, known).select("p_partkey", "name")


@query("""SELECT lang, count(*) AS n, string_agg(CASE WHEN r <= 20 THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS first FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) GROUP BY lang""")
def language_histogram(spark, d):
    rows = inventory.histogram(_read(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id")
    return rows.select("lang", "n", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first"))


# Correlation --------------------------------------------------------------------------------------


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers consume and suppliers provide by nation; a customer may state a supplier's name."""
    c = _read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.format_string("Supplier#%09d", F.col("c_custkey") % 150).alias("stated"))
    return c, _read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_name", F.col("s_suppkey").cast("string").alias("s_id"))


def _correlated(spark: SparkSession, d: str) -> DataFrame:
    c, s = _sides(spark, d)
    return correlation.correlate(c, s, ["nation"], "c_custkey", "s_suppkey", "stated", ["s_name", "s_id"])


_CORRELATED = """SELECT c_custkey, c_nationkey AS nation, coalesce(n, 0)::BIGINT AS candidate_count, coalesce(p, 0)::BIGINT AS proven_count,
 CASE WHEN coalesce(p, 0) = 1 THEN proven WHEN n = 1 THEN least END AS provider,
 CASE WHEN coalesce(n, 0) = 0 THEN 'unmatched' WHEN p = 1 THEN 'matched_confirmed' WHEN n = 1 THEN 'unique_candidate' ELSE 'ambiguous' END AS status
 FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS least FROM supplier GROUP BY 1) c ON c_nationkey = s_nationkey
 LEFT JOIN (SELECT s_nationkey AS pn, s_name, count(*) AS p, min(s_suppkey) AS proven FROM supplier GROUP BY 1, 2) q ON c_nationkey = pn AND s_name = printf('Supplier#%09d', c_custkey % 150)"""


@query("""SELECT c_custkey, c_nationkey AS nation, coalesce(n, 0)::BIGINT AS candidate_count, 0::BIGINT AS proven_count, CASE WHEN n = 1 THEN least END AS provider,
 CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'unique_candidate' ELSE 'ambiguous' END AS status
 FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS least FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey""")
def correlate(spark, d):
    c, s = _sides(spark, d)
    return correlation.correlate(c, s, ["nation"], "c_custkey", "s_suppkey")


@query(_CORRELATED)
def correlate_identity(spark, d):
    return _correlated(spark, d)


@query(f"""SELECT count(*) AS consumers, count(*) FILTER (status = 'matched_confirmed') AS matched_confirmed, count(*) FILTER (status = 'unique_candidate') AS unique_candidate,
 count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched, count(DISTINCT provider) AS providers_named, true AS reconciled FROM ({_CORRELATED})""")
def correlate_coverage(spark, d):
    return correlation.coverage(_correlated(spark, d))


@query(f"""WITH c AS ({_CORRELATED}) SELECT provider AS s_suppkey, status, c_custkey FROM c WHERE provider IS NOT NULL""")
def reverse_index(spark, d):
    c, s = _sides(spark, d)
    return correlation.reverse_index(_correlated(spark, d), s, ["nation"], "c_custkey", "s_suppkey").select("s_suppkey", "status", "c_custkey")


@query(f"""WITH c AS ({_CORRELATED}), a AS (SELECT nation, count(*) AS n FROM c WHERE status = 'ambiguous' GROUP BY 1) SELECT s_suppkey, coalesce(n, 0)::BIGINT AS ambiguous FROM supplier LEFT JOIN a ON s_nationkey = nation""")
def ambiguous_consumers(spark, d):
    c, s = _sides(spark, d)
    return correlation.ambiguous_of(_correlated(spark, d), s, ["nation"], "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000)")
def unmatched(spark, d):
    return _read(spark, d, "customer").join(_read(spark, d, "supplier").where("s_acctbal > 9000"), F.col("c_nationkey") == F.col("s_nationkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < -900)")
def consumed_providers(spark, d):
    return _read(spark, d, "supplier").join(_read(spark, d, "customer").where("c_acctbal < -900"), F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("s_suppkey")


@query("SELECT event_type FROM (SELECT DISTINCT event_type FROM events) WHERE event_type NOT IN ('click', 'view')")
def unsupported_detectors(spark, d):
    supported = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return inventory.unsupported(_read(spark, d, "events").select("event_type").distinct(), supported, "event_type")


# Merging ------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def snapshot_dedupe(spark, d):
    return merging.snapshots(_read(spark, d, "documents"), "text", "doc_id")


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS commits, count(DISTINCT o_orderpriority) AS contents, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'different_commits' ELSE 'different_contents' END AS conflict
 FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def snapshot_conflict(spark, d):
    return merging.snapshot_conflicts(_read(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_identity(spark, d):
    return merging.duplicate_identities(_read(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""WITH f AS (SELECT user_id, event_type, props, min(event_id) AS first, bool_or(value > 20) AS sure FROM events GROUP BY 1, 2, 3)
 SELECT user_id, event_type, string_agg(props, ';' ORDER BY first) AS evidence, CASE WHEN bool_or(sure) THEN 'confirmed' ELSE 'probable' END AS confidence FROM f GROUP BY 1, 2""")
def endpoint_merge(spark, d):
    rows = _read(spark, d, "events").withColumn("confidence", F.when(F.col("value") > 20, "confirmed").otherwise("probable"))
    merged = merging.merge_evidence(rows, ["user_id", "event_type"], "event_id", "props", "confidence")
    return merged.select("user_id", "event_type", F.array_join("props", ";").alias("evidence"), "confidence")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY 1, 2")
def last_definition(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("seen"), "event_id", "props")
    return merging.last_wins(rows, ["user_id", "event_type"], "seen").select("user_id", "event_type", "event_id", "props")


@query("""SELECT code, count(*) AS n, CASE WHEN contains(code, 'soap') OR contains(code, 'integration') THEN 'integration' WHEN contains(code, 'semantic') THEN 'semantics' WHEN contains(code, 'contract') OR contains(code, 'request') OR contains(code, 'response') THEN 'contract'
 WHEN contains(code, 'route') OR contains(code, 'url') THEN 'endpoint' ELSE 'other' END AS category
 FROM (SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN 'slim_dynamic_route_unresolved' WHEN 1 THEN 'soap_operation_unresolved' WHEN 2 THEN 'slim_php_request_body_dynamic' WHEN 3 THEN 'slim_php_semantic_dynamic_sql' WHEN 4 THEN 'axios_dynamic_url_unresolved' ELSE 'unsupported_http_client' END AS code, user_id FROM events WHERE event_type = 'error') GROUP BY 1, 3""")
def unresolved_issues(spark, d):
    codes = ["slim_dynamic_route_unresolved", "soap_operation_unresolved", "slim_php_request_body_dynamic", "slim_php_semantic_dynamic_sql", "axios_dynamic_url_unresolved", "unsupported_http_client"]
    rows = _read(spark, d, "events").where("event_type = 'error'").withColumn("code", F.element_at(F.array(*map(F.lit, codes)), (F.col("event_id") % 6 + 1).cast("int")))
    once = merging.distinct_unresolved(rows, ["code", "user_id"])
    return once.groupBy("code").agg(F.count("*").alias("n")).withColumn("category", merging.issue_category(F.col("code")))


# Compatibility ------------------------------------------------------------------------------------


def _set_sides(spark: SparkSession, d: str) -> DataFrame:
    """Each user's kinds of events in either half of the table, as field sets; null where a half has none."""
    e = _read(spark, d, "events").withColumn("kind", F.concat("event_type", F.lit("_"), (F.col("value") / 20).cast("int").cast("string")))
    early = F.col("event_id") % 2 == 0
    return e.groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(early & (F.col("value") > 15), F.col("kind")))).alias("a"), F.array_sort(F.collect_set(F.when(~early & (F.col("value") > 15), F.col("kind")))).alias("b"))


@query("""WITH e AS (SELECT user_id, event_id % 2 = 0 AS early, event_type || '_' || trunc(value / 20)::INT AS kind FROM events WHERE value > 15), u AS (SELECT DISTINCT user_id FROM events),
 s AS (SELECT u.user_id, list_sort(coalesce(list(DISTINCT kind) FILTER (early), [])) AS a, list_sort(coalesce(list(DISTINCT kind) FILTER (NOT early), [])) AS b FROM u LEFT JOIN e ON u.user_id = e.user_id GROUP BY 1)
 SELECT user_id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS removed, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS added,
 CASE WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 THEN 'breaking' WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 THEN 'unknown' ELSE 'same' END AS classification FROM s""")
def compare_sets(spark, d):
    """Response fields removed are breaking, fields added of unknown tolerance are unknown."""
    side = lambda fields: F.from_json(F.lit("{}"), compat.RESPONSE).withField("fields", fields)
    rows = _set_sides(spark, d).select("user_id", side(F.col("a")).alias("x"), side(F.col("b")).alias("y"))
    found = rows.select("user_id", F.filter(compat.compare_response(F.col("x"), F.col("y")), lambda f: f["code"].isin("response_field_removed", "response_field_addition_compatibility_unknown")).alias("f"))
    of = lambda kind: F.array_join(F.transform(F.filter("f", lambda f: f["classification"] == kind), lambda f: f["detail"]), ",")
    return found.select("user_id", of("breaking").alias("removed"), of("unknown").alias("added"), compat.worst(F.col("f")).alias("classification"))


_STATE = "CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END"
_AFTER = "CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN true WHEN left(o_orderpriority, 1) IN ('3', '4') THEN false END"


@query(f"""SELECT o_orderkey, CASE WHEN a IS NULL OR b IS NULL THEN 'parameter_requiredness_unknown' WHEN NOT a AND b THEN 'parameter_requiredness_became_stricter' ELSE '' END AS codes,
 CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN NOT a AND b THEN 'breaking' ELSE 'same' END AS classification FROM (SELECT o_orderkey, {_STATE} AS a, {_AFTER} AS b FROM orders)""")
def compare_requiredness(spark, d):
    one = lambda need: F.create_map(F.lit("query:q"), F.struct(F.expr(need).alias("required"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("format")))
    found = _read(spark, d, "orders").select("o_orderkey", compat.compare_parameters(one(_STATE), one(_AFTER)).alias("f"))
    return found.select("o_orderkey", F.array_join(F.transform("f", lambda f: f["code"]), ",").alias("codes"), compat.worst(F.col("f")).alias("classification"))


_KIND_SQL = "CASE {} % 3 WHEN 1 THEN 'string' WHEN 2 THEN 'integer' END"
_FORM_SQL = "CASE {} % 3 WHEN 1 THEN 'date' WHEN 2 THEN 'uuid' END"


@query(f"""WITH r AS (SELECT o_orderkey, {_KIND_SQL.format('o_orderkey')} AS a, {_KIND_SQL.format('o_custkey')} AS b, {_FORM_SQL.format('length(o_orderpriority)')} AS m, {_FORM_SQL.format('floor(o_totalprice)::BIGINT')} AS n FROM orders)
 SELECT coalesce(a, '-') AS type_a, coalesce(b, '-') AS type_b, coalesce(m, '-') AS format_a, coalesce(n, '-') AS format_b,
 concat_ws(',', CASE WHEN a IS NULL OR b IS NULL THEN 'type_unknown' END, CASE WHEN a <> b THEN 'type_changed' END, CASE WHEN m <> n THEN 'format_changed' END, CASE WHEN (m IS NULL) <> (n IS NULL) THEN 'format_unknown' END) AS codes, count(*) AS n
 FROM r GROUP BY 1, 2, 3, 4, 5""")
def type_format_profile(spark, d):
    """Types and formats of both sides by columns of every order, and how often each pair of profiles has which findings."""
    pick = lambda x, names: F.when(x % 3 == 1, names[0]).when(x % 3 == 2, names[1])
    sides = {"ta": F.col("o_orderkey"), "tb": F.col("o_custkey"), "fa": F.length("o_orderpriority"), "fb": F.floor("o_totalprice")}
    rows = _read(spark, d, "orders").select(*[pick(x, ("string", "integer") if name[0] == "t" else ("date", "uuid")).alias(name) for name, x in sides.items()])
    codes = {"type": "type_changed", "format": "format_changed", "unknown_type": "type_unknown", "unknown_format": "format_unknown"}
    found = compat.compare_profile((F.col("ta"), F.col("fa")), (F.col("tb"), F.col("fb")), F.lit("x"), codes)
    shown = [F.coalesce(c, F.lit("-")).alias(n) for c, n in (("ta", "type_a"), ("tb", "type_b"), ("fa", "format_a"), ("fb", "format_b"))]
    told = rows.select(*shown, F.array_join(F.transform(found, lambda f: f["code"]), ",").alias("codes"))
    return told.groupBy("type_a", "type_b", "format_a", "format_b", "codes").agg(F.count("*").alias("n"))


def contract(**parts: F.Column) -> F.Column:
    """A contract with the given dotted fields, and every other fact unknown."""
    base = F.from_json(F.lit('{"request":{},"response":{},"authentication":{},"behavior":{}}'), compat.CONTRACT)
    for name, value in parts.items():
        base = base.withField(name.replace("__", "."), value)
    return base


def _customer_contract() -> F.Column:
    k = F.col("c_custkey")
    strings = lambda *x: F.array(*map(F.lit, x))
    return contract(
        contract_status=F.when(k % 5 == 0, F.lit("partial")).otherwise("complete"),
        semantic_status=F.when(k % 7 == 0, F.lit("unknown")).otherwise("complete"),
        request__fields=strings("a", "b"),
        request__content_type=F.when(k % 3 != 0, F.lit("application/json")),
        response__fields=strings("x"),
        response__content_type=F.lit("application/json"),
        response__status_codes=F.when(k % 2 == 0, F.array(F.lit(200))),
        authentication__authentication=F.when(F.col("c_acctbal") > 0, F.lit("bearer")),
    )


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'contract_status' END, CASE WHEN c_custkey % 7 = 0 THEN 'semantic_status' END, CASE WHEN c_custkey % 3 = 0 THEN 'request_content_type' END,
 CASE WHEN c_custkey % 2 <> 0 THEN 'response' END, CASE WHEN c_acctbal > 0 THEN NULL ELSE 'authentication' END) AS reasons FROM customer""")
def material_unknown(spark, d):
    return _read(spark, d, "customer").select("c_custkey", F.array_join(compat.material_unknown(_customer_contract()), ",").alias("reasons"))


def _orders_contract(known: F.Column, fields: F.Column, need: F.Column) -> F.Column:
    return contract(
        contract_status=F.lit("complete"), semantic_status=F.lit("complete"), materiality=F.lit("internal"), request__fields=fields, request__required_fields=need, request__content_type=F.lit("application/json"),
        request__types=F.map_from_arrays(fields, F.transform(fields, lambda _: F.lit("string"))), request__accepts_additional_fields=known,
        response__fields=F.array(F.lit("id")), response__fields_used_by_consumer=F.array(F.lit("id")), response__types=F.create_map(F.lit("id"), F.lit("integer")), response__content_type=F.lit("application/json"),
        response__status_codes=F.array(F.lit(200)), authentication__authentication=F.lit("bearer"), authentication__required=F.lit(True),
    )


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Orders depend on suppliers by their customer's number: none, one or several provide; fields and tolerance vary by key."""
    k = F.col("o_orderkey")
    sent = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    consumers = _read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("api"), _orders_contract(F.lit(None).cast("boolean"), sent, F.array().cast("array<string>")).alias("contract"))
    s = F.col("s_suppkey")
    providers = _read(spark, d, "supplier").select(F.when(s % 10 == 3, s - 1).otherwise(s).alias("api"), _orders_contract(F.when(s % 3 == 0, F.lit(True)), F.array(F.lit("a"), F.lit("b")), F.when(s % 5 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("contract"))
    return consumption.check_consumers(consumers, providers, ["api"], "o_orderkey")


_CHECKED = """SELECT o_orderkey, api, coalesce(n, 0)::BIGINT AS n_providers,
 CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN NOT extra THEN 'compatible' WHEN s % 5 = 0 THEN 'breaking' WHEN s % 3 = 0 THEN 'compatible' ELSE 'unknown' END AS status
 FROM (SELECT o_orderkey, o_custkey AS api, o_orderkey % 4 = 0 AS extra FROM orders) o
 LEFT JOIN (SELECT CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey - 1 ELSE s_suppkey END AS a, count(*) AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1) p ON api = a"""


@query(_CHECKED)
def consumer_compat(spark, d):
    return _checked(spark, d).select("o_orderkey", "api", "n_providers", "status")


@query(f"""WITH c AS ({_CHECKED}), b AS (SELECT bool_or(status IN ('breaking', 'missing')) AS breaking, bool_or(status IN ('unknown', 'ambiguous')) AS unclear FROM c)
 SELECT mode, CASE WHEN mode = 'report' THEN 'passed' WHEN breaking THEN 'failed' WHEN mode = 'strict' AND unclear THEN 'failed' ELSE 'passed' END AS gate FROM b, (VALUES ('report'), ('breaking'), ('strict')) m(mode)""")
def gate_modes(spark, d):
    s = consumption.summary(_checked(spark, d))
    breaking, unknown = (F.col("breaking") > 0) | (F.col("missing") > 0), (F.col("unknown") > 0) | (F.col("ambiguous") > 0)
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), compat.gate(m, breaking, unknown).alias("gate")) for m in ("report", "breaking", "strict")])
    return s.select(F.explode(modes).alias("m")).select("m.mode", "m.gate")


def _compared(spark: SparkSession, d: str, policy: bool) -> DataFrame:
    """Parts as endpoints of two catalogs: sizes decide what the candidate lost, gained or weakened."""
    p = _read(spark, d, "part")
    k = F.col("p_partkey")

    def side(new: bool) -> F.Column:
        fields = F.when(F.lit(new) & (F.col("p_size") % 4 == 0), F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
        mechanism = F.when(F.lit(new) & (F.col("p_size") % 5 == 0), F.lit(None).cast("string")).otherwise(F.lit("admin"))
        return contract(
            contract_status=F.lit("complete"), semantic_status=F.lit("complete"), materiality=F.lit("internal"), request__fields=F.array(F.lit("q")), request__content_type=F.lit("json"), request__types=F.create_map(F.lit("q"), F.lit("string")),
            response__fields=fields, response__types=F.create_map(F.lit("a"), F.lit("string"), F.lit("b"), F.lit("string")), response__content_type=F.lit("json"), response__status_codes=F.array(F.lit(200)),
            authentication__authentication=F.lit("bearer"), authentication__authorization=mechanism,
        )

    old = p.where("p_partkey % 10 <> 7").select("p_partkey", side(False).alias("contract"))
    return compat.compare_contracts(old, p.where("p_partkey % 10 <> 8").select(k.alias("p_partkey"), side(True).alias("contract")), ["p_partkey"], policy)


_CLASS = "CASE WHEN p_partkey % 10 = 8 THEN 'breaking' WHEN p_partkey % 10 = 7 THEN 'additive' WHEN p_size % 4 = 0 THEN 'breaking' WHEN p_size % 5 = 0 AND {} THEN 'breaking' ELSE 'same' END"


@query(f"SELECT p_partkey, {_CLASS.format('false')} AS classification, (p_partkey % 10 <> 7) AS required FROM part")
def compare_catalogs(spark, d):
    return _compared(spark, d, False).select("p_partkey", "classification", "required")


@query(f"""SELECT count(*) AS endpoints, count(*) FILTER (p_partkey % 10 <> 7) AS required_endpoints, count(*) FILTER (c = 'same') AS same, count(*) FILTER (c = 'additive') AS additive, 0::BIGINT AS "unknown", count(*) FILTER (c = 'breaking') AS breaking,
 count(*) FILTER (both_sides AND p_size % 5 = 0 AND false) AS same_findings, count(*) FILTER (p_partkey % 10 = 7) AS additive_findings, 0::BIGINT AS unknown_findings,
 count(*) FILTER (p_partkey % 10 = 8) + count(*) FILTER (both_sides AND p_size % 4 = 0) + count(*) FILTER (both_sides AND p_size % 5 = 0) AS breaking_findings, count(*) FILTER (both_sides AND p_size % 5 = 0) AS security_drift
 FROM (SELECT *, {_CLASS.format('true')} AS c, p_partkey % 10 NOT IN (7, 8) AS both_sides FROM part)""")
def security_drift(spark, d):
    return compat.summary(_compared(spark, d, True))


# Validation, spans, reach, gates ------------------------------------------------------------------


@query("""SELECT o_orderkey, 'o_orderpriority' AS field, 'pattern' AS rule FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
 UNION ALL SELECT o_orderkey, 'o_orderstatus', 'enum' FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT o_orderkey, 'o_totalprice', 'maximum' FROM orders WHERE o_totalprice > 300000
 UNION ALL SELECT o_orderkey, 'o_totalprice', 'type' FROM orders WHERE o_totalprice <> floor(o_totalprice)""")
def schema_violations(spark, d):
    rules = [validation.Constraint("o_orderpriority", pattern="^[1-4]-"), validation.Constraint("o_orderstatus", one_of=("O", "F")), validation.Constraint("o_totalprice", most=300000, integer=True)]
    return validation.violations(_read(spark, d, "orders"), "o_orderkey", rules)


@query("""SELECT event_id, 'props.k' AS field, 'minimum' AS rule FROM events WHERE (props->>'$.k')::DOUBLE < 10 UNION ALL SELECT event_id, 'props.k', 'maximum' FROM events WHERE (props->>'$.k')::DOUBLE > 90""")
def json_constraints(spark, d):
    return validation.violations(_read(spark, d, "events"), "event_id", [validation.Constraint("props", json_path="$.k", least=10, most=90, integer=True)])


@query("""WITH s AS (SELECT user_id, event_id AS lo, event_id + 100 + CAST(k AS BIGINT) AS hi, event_type AS name FROM (SELECT *, (props->>'$.k') AS k FROM events)),
 h AS (SELECT e.event_id, name, row_number() OVER (PARTITION BY e.event_id ORDER BY hi - lo, name) AS r FROM events e JOIN s ON e.user_id = s.user_id AND e.event_id BETWEEN lo AND hi)
 SELECT e.event_id, h.name FROM events e LEFT JOIN h ON e.event_id = h.event_id AND r = 1""")
def interval_join(spark, d):
    e = _read(spark, d, "events")
    held = e.select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 100 + F.get_json_object("props", "$.k").cast("bigint")).alias("hi"), F.col("event_type").alias("name"))
    return spans.smallest_enclosing(e.select("event_id", "user_id"), held, ["user_id"], "event_id", "event_id", "lo", "hi", "name")


@query("""WITH s AS (SELECT o_orderkey AS o, 100 * o_orderkey AS lo, 100 * o_orderkey + 90 AS hi, 'order ' || o_orderkey AS scope FROM orders
 UNION ALL SELECT l_orderkey, 100 * l_orderkey + 10 * l_linenumber, 100 * l_orderkey + 10 * l_linenumber + 6 + max(l_partkey % 5), 'line ' || l_orderkey || '-' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber),
 p AS (SELECT DISTINCT l_orderkey AS o, 100 * l_orderkey + l_suppkey % 100 AS point FROM lineitem),
 h AS (SELECT point, scope, row_number() OVER (PARTITION BY point ORDER BY hi - lo) AS r FROM p JOIN s ON p.o = s.o AND point >= lo AND point < hi)
 SELECT p.point, h.scope FROM p LEFT JOIN h ON p.point = h.point AND r = 1""")
def scope_sweep(spark, d):
    """Orders and their lines as nested, often touching scopes of five files, and points around them: the innermost scope of each."""
    orders = _read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    lines = _read(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    outer = orders.select("o_orderpriority", (100 * F.col("o_orderkey")).alias("lo"), (100 * F.col("o_orderkey") + 90).alias("hi"), F.concat(F.lit("order "), "o_orderkey").alias("scope"))
    start = 100 * F.col("l_orderkey") + 10 * F.col("l_linenumber")
    inner = lines.groupBy("o_orderpriority", "l_orderkey", "l_linenumber").agg(F.max(6 + F.col("l_partkey") % 5).alias("size")).select(
        "o_orderpriority", start.alias("lo"), (start + F.col("size")).alias("hi"), F.concat(F.lit("line "), "l_orderkey", F.lit("-"), "l_linenumber").alias("scope")
    )
    points = lines.select("o_orderpriority", (100 * F.col("l_orderkey") + F.col("l_suppkey") % 100).alias("point")).distinct().withColumn("at", F.col("point"))
    return spans.innermost_scope(points, outer.unionByName(inner), ["o_orderpriority"], "point", "at", "lo", "hi", "scope", 1 << 12)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    r = _read(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("caller"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("callee"))
    c = _read(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("caller"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("callee"))
    back = _read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("caller"), F.concat(F.lit("r"), F.pmod("c_custkey", F.lit(5)).cast("string")).alias("callee"))
    return r.unionByName(c).unionByName(back)


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'r' || c_custkey % 5 FROM customer),
 t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT root, b, depth + 1 FROM t JOIN e ON node = a WHERE depth < 4)
 SELECT root, node, min(depth) AS depth FROM t GROUP BY 1, 2""")
def helper_reach(spark, d):
    roots = _read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return reach.reachable(roots, _calls(spark, d), 4)


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_partkey IS NOT NULL AS defined_in_wsdl FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def contract_lookup(spark, d):
    from quaymark.sources.wsdl import meet_contracts

    known = _read(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.lit("x").alias("operation"))
    return meet_contracts(_read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), known, ["l_partkey"]).drop("operation")


@query("SELECT source, count(*) AS n, count(*) FILTER (n_chars < 60) AS pending, bool_and(lang IN ('en', 'fr', 'de')) AS all_supported, CASE WHEN bool_and(lang IN ('en', 'fr', 'de')) AND count(*) FILTER (n_chars < 60) = 0 THEN 'complete' ELSE 'partial' END AS status FROM documents GROUP BY 1")
def completion_gate(spark, d):
    return gates.group_completion(_read(spark, d, "documents"), ["source"], F.col("lang").isin("en", "fr", "de"), F.col("n_chars") < 60)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'complete' ELSE 'partial' END AS status FROM orders""")
def audit_status(spark, d):
    k = F.col("o_orderkey")
    supported = F.when(k % 3 != 0, F.array(F.lit("exposed"), F.lit("consumed"))).otherwise(F.array(F.lit("exposed")))
    status = gates.completion(k % 7 != 0, F.col("o_orderstatus") == "F", F.array(F.lit("consumed")), supported, F.lit(0))
    return _read(spark, d, "orders").select("o_orderkey", status.alias("status"))


@query("""SELECT o_orderkey, CASE k WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'partial' WHEN 3 THEN 'not_applicable' WHEN 4 THEN 'unresolved' ELSE 'unknown' END AS contract_status,
 CASE WHEN o_orderstatus = 'O' THEN 'complete' WHEN o_orderstatus = 'F' THEN 'partial' ELSE 'unknown' END AS semantic_status FROM (SELECT *, o_orderkey % 7 AS k FROM orders)""")
def contract_statuses(spark, d):
    """Statuses from notes and words: known ones through the table, any other word or no note is unknown."""
    k = F.col("o_orderkey") % 7
    words = ("evaluated_complete", "evaluated_partial", "required_not_complete", "not_applicable", "unresolved", "nonsense=complete")
    note = None
    for n, w in enumerate(words):
        note = F.when(k == n, f"{projection.STATUS_NOTE}={w}") if note is None else note.when(k == n, f"{projection.STATUS_NOTE}={w}")
    notes = F.array_compact(F.array(F.lit("seen=1"), note, F.lit(f"x{projection.STATUS_NOTE}=complete")))
    word = F.when(F.col("o_orderstatus") == "O", "complete").when(F.col("o_orderstatus") == "F", "partial").otherwise("evaluated_partial")
    return _read(spark, d, "orders").select("o_orderkey", projection.contract_status(notes).alias("contract_status"), projection.semantic_status(word).alias("semantic_status"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN r THEN 'a' END, CASE WHEN l_linenumber % 2 = 0 THEN 'z' END) AS required, CASE WHEN NOT r AND o THEN 'a' ELSE '' END AS optional, concat_ws(',', CASE WHEN NOT r AND NOT o THEN 'a' END, 'b') AS unsure
 FROM (SELECT *, l_returnflag = 'R' AS r, l_linestatus = 'O' AS o FROM lineitem)""")
def requiredness(spark, d):
    """Declared optional counts only for fields that are there and not required; names may repeat or be null."""
    fields = F.array(F.lit("b"), F.lit("a"), F.lit("a"), F.lit(None))
    required = F.array(F.when(F.col("l_linenumber") % 2 == 0, "z"), F.when(F.col("l_returnflag") == "R", "a"))
    optional = F.array(F.when(F.col("l_linestatus") == "O", "a"), F.lit("gone"))
    need, free, unsure = (F.array_join(x, ",") for x in projection.requiredness(fields, required, optional))
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", need.alias("required"), free.alias("optional"), unsure.alias("unsure"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'header:h=false,path:id=true,path:key=true' WHEN 1 THEN 'path:id=false,path:key=true' ELSE 'path:id=true,path:key=true' END AS parameters FROM customer""")
def path_parameters(spark, d):
    """Placeholders that a contract does not list are required parameters; listed ones stay as they are."""
    k = F.col("c_custkey") % 3
    listed = F.when(k == 0, '{"header:h":{"required":false}}').when(k == 1, '{"path:id":{"required":false}}')
    known = F.from_json(listed, f"map<string,{projection.PARAMETER}>")
    path = F.concat(F.lit("/c/{id:[0-9]+}/"), F.col("c_custkey").cast("string"), F.lit("/{key}/{id}"))
    entries = F.array_sort(F.map_entries(projection.with_path_parameters(known, path)))
    return _read(spark, d, "customer").select("c_custkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]["required"].cast("string"))), ",").alias("parameters"))


@query("""SELECT l_orderkey, l_linenumber, c AS contract_scope, g AS correlation_scope, CASE WHEN l_linenumber <> 7 AND l_tax = 0 AND c <> 'required_not_complete' AND g <> 'required_not_evaluable' THEN 'complete' ELSE 'partial' END AS status
 FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 'not_applicable' WHEN l_returnflag = 'R' THEN 'evaluated_partial' WHEN l_linestatus = 'O' THEN 'evaluated_complete' ELSE 'required_not_complete' END AS c,
  CASE WHEN l_returnflag <> 'A' THEN 'out_of_scope' WHEN l_linenumber = 2 THEN 'not_applicable' ELSE 'required_not_evaluable' END AS g FROM lineitem)""")
def audit_gates(spark, d):
    """The audit's gate: every open count or unknown fact keeps it from being complete."""
    contracts = gates.contract_scope(F.when(F.col("l_linenumber") == 1, 0).otherwise(3), F.when(F.col("l_linestatus") == "O", 0).otherwise(2), F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    links = gates.correlation_scope(F.when(F.col("l_linenumber") == 2, 0).otherwise(1), F.col("l_returnflag") == "A")
    rows = _read(spark, d, "lineitem").withColumn("contract_scope", contracts).withColumn("correlation_scope", links)
    taxed = F.when(F.col("l_tax") > 0, 1).otherwise(0)
    status = gates.audit_gate(F.when(F.col("l_linenumber") != 7, True), F.lit(True), F.lit(0), taxed, F.lit(0), F.col("contract_scope"), F.col("correlation_scope"))
    return rows.select("l_orderkey", "l_linenumber", "contract_scope", "correlation_scope", status.alias("status"))


@query("""SELECT o_custkey, concat_ws(',', 'inventory', CASE WHEN h OR w THEN 'framework' END, 'configuration', CASE WHEN h THEN 'exposed' END, CASE WHEN f THEN 'consumed' END) AS categories,
 concat_ws(',', CASE WHEN f THEN 'consumed:axios' END, CASE WHEN h THEN 'exposed:slim' END, CASE WHEN h THEN 'framework:slim' END, CASE WHEN w THEN 'framework:vue' END) AS hints
 FROM (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS h, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'P') AS w FROM orders GROUP BY 1)""")
def detector_plan(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "http_client").otherwise("framework")
    name = F.when(F.col("o_orderstatus") == "F", "axios").when(F.col("o_orderstatus") == "O", "slim").otherwise("vue")
    plan = inventory.detector_plan(_read(spark, d, "orders").select("o_custkey", name.alias("name"), kind.alias("kind")), "o_custkey")
    return plan.select("o_custkey", F.array_join("categories", ",").alias("categories"), F.array_join("hints", ",").alias("hints"))


@query("""SELECT event_id, '$.k' AS path, 'minimum' AS rule FROM events WHERE (props->>'$.k')::INT < 5 UNION ALL SELECT event_id, '$.k', 'maximum' FROM events WHERE (props->>'$.k')::INT > 95
 UNION ALL SELECT event_id, '$.type', 'enum' FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id, '$.extra', 'additionalProperties' FROM events WHERE event_id % 9 = 0
 UNION ALL SELECT event_id, '$.items[1]', 'type' FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, '$.name', 'required' FROM events WHERE event_id % 6 = 1 UNION ALL SELECT event_id, '$.name', 'minLength' FROM events WHERE event_id % 6 = 2""")
def document_rules(spark, d):
    """Documents against a JSON schema with references, closed objects, item types and bounds."""
    schema = {
        "$defs": {"word": {"type": "string", "minLength": 1}}, "type": "object", "required": ["k", "name"], "additionalProperties": False,
        "properties": {"k": {"type": "integer", "minimum": 5, "maximum": 95}, "type": {"enum": ["click", "view"]}, "name": {"$ref": "#/$defs/word"}, "items": {"type": "array", "items": {"$ref": "#/$defs/word"}, "minItems": 1}},
    }
    k = F.col("event_id")
    text = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"type":"'), F.col("event_type"), F.lit('","items":["a",'), F.when(k % 5 == 0, "1").otherwise('"b"'), F.lit("]"),
        F.when(k % 6 == 1, "").when(k % 6 == 2, ',"name":""').otherwise(',"name":"n"'), F.when(k % 9 == 0, ',"extra":{}').otherwise(""), F.lit("}"),
    )
    return schema_rules.document_violations(_read(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text", schema)


# Reports ------------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, {_TEMPLATED} AS path FROM pages), s AS (SELECT *, {SHAPE_SQL.format('path')} AS shape, replace(path, '{{item_id:[0-9]+}}', '{{param1}}') AS canonical FROM e)
 SELECT shape, min(canonical) AS canonical, string_agg(method, ',' ORDER BY method) AS methods FROM s GROUP BY shape""")
def openapi_group(spark, d):
    rows = _templated_pages(spark, d).withColumn("method", F.when(F.col("page_id") % 3 == 0, "get").when(F.col("page_id") % 3 == 1, "post").otherwise("put"))
    groups = render.grouped_paths(rows)
    return groups.select("shape", "canonical", F.array_join("methods", ",").alias("methods"))


@query("""SELECT r_name AS section, string_agg('| ' || n_name || ' |' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'even' || chr(10) ELSE '' END || '---', chr(10) ORDER BY n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def render_lines(spark, d):
    rows = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = render.joined(render.lines(rows, [F.col("r_name"), F.col("n_name")], F.concat(F.lit("| "), F.col("n_name"), F.lit(" |")), F.when(F.col("n_nationkey") % 2 == 0, F.lit("even")), F.lit("---")))
    region = F.substring_index("section", "\u0001", 1)
    return one.groupBy(region.alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN c_name END AS name, CASE c_custkey % 4 WHEN 1 THEN 'a: b' WHEN 3 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def front_matter(spark, d):
    """Values may hold colons and blanks; a page without a closed block has none; what follows the block does not count."""
    k = F.col("c_custkey") % 4
    end = F.when(k == 2, "---\n---\nname: other\n---\n").otherwise("---\nbody: no\nsegment: no\n")
    page = F.concat(F.when(k == 3, "\n---\n").otherwise("---\n"), F.lit("name: "), F.col("c_name"), F.lit("\nno pair\nsegment:  "), F.when(k == 1, "a: b").otherwise(F.col("c_mktsegment")), F.lit("  \n"), end)
    found = render.parse_front_matter(page)
    return _read(spark, d, "customer").select("c_custkey", F.try_element_at(found, F.lit("name")).alias("name"), F.try_element_at(found, F.lit("segment")).alias("segment"))


# Published sets -----------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT c_custkey, regexp_replace(said, '(password|api_key)=\S+', '\1=[REDACTED]', 'g') AS hidden, said FROM
 (SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN ' password=' || c_nationkey WHEN 1 THEN ' passwords ' || c_nationkey ELSE ' api_key=' || c_nationkey || ' password=' || c_custkey END || ' in ' || c_mktsegment AS said FROM customer))
 SELECT c_custkey, said <> hidden AS secret, false AS secret_after, hidden AS in_struct, hidden AS in_array, hidden AS in_key, hidden AS in_value FROM c""")
def nested_secrets(spark, d):
    """Credentials in structs, arrays of structs, and keys and values of maps: found before and gone after they are hidden."""
    from quaymark.functions import frames, nested

    customer = _read(spark, d, "customer")
    customer = frames.dealt(customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), customer.count(), 20_000, "c_custkey")  # a small file is one task
    key = F.col("c_custkey")
    held = F.when(key % 3 == 0, F.concat(F.lit(" password="), "c_nationkey")).when(key % 3 == 1, F.concat(F.lit(" passwords "), "c_nationkey")).otherwise(F.concat(F.lit(" api_key="), "c_nationkey", F.lit(" password="), "c_custkey"))
    said = F.concat("c_name", held, F.lit(" in "), "c_mktsegment").alias("said")
    deep = customer.select("c_custkey", said).select("c_custkey", F.struct(F.struct("said").alias("a"), F.array(F.struct("said")).alias("b"), F.create_map("said", F.array("said")).alias("c")).alias("s"))
    kind = deep.schema["s"].dataType
    shown = nested.each_text(F.col("s"), kind, text.redact)
    rows = deep.select("c_custkey", "s", shown.alias("t"))
    return rows.select(
        "c_custkey", nested.any_text(F.col("s"), kind, text.secret_like).alias("secret"), nested.any_text(F.col("t"), kind, text.secret_like).alias("secret_after"),
        F.col("t.a.said").alias("in_struct"), F.col("t.b")[0]["said"].alias("in_array"), F.map_keys("t.c")[0].alias("in_key"), F.map_values("t.c")[0][0].alias("in_value"),
    )


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_suppkey":' || l_suppkey || '}') AS h FROM lineitem)
 SELECT l_returnflag, l_linestatus, count(*) AS rows, sha256(concat_ws(':', count(*), sum(('0x' || h[1:15])::BIGINT), sum(('0x' || h[16:30])::BIGINT), sum(('0x' || h[31:45])::BIGINT), sum(('0x' || h[46:60])::BIGINT))) AS digest
 FROM r GROUP BY 1, 2""")
def set_digest(spark, d):
    """The digest of each part of a set, whatever the order of its rows."""
    from quaymark.functions import digests

    rows = _read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return digests.set_digest(rows, ["l_returnflag", "l_linestatus"])


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS number FROM events")
def line_numbers(spark, d):
    """Rows numbered in a total order over all partitions."""
    from quaymark.sources import ordered

    return ordered.numbered(_read(spark, d, "events").select("value", "event_id"), ["value", "event_id"]).select("event_id", "number")


# Rules and names as tables ------------------------------------------------------------------------


@query("""WITH d AS (SELECT p_partkey, lower(replace(p_type, ' ', '.')) || '.' || p_partkey AS dependency, 'e' || p_size % 3 AS ecosystem FROM part),
 k AS (SELECT DISTINCT 'e' || p_partkey % 3 AS ecosystem, CASE p_partkey % 5 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN lower(substr(p_type, 3, 6)) WHEN 2 THEN (p_partkey % 90)::VARCHAR WHEN 3 THEN substr(lower(p_type), 2, 2) ELSE 'none' || p_partkey END AS name FROM part WHERE p_partkey % 20 < 5)
 SELECT p_partkey, name FROM d JOIN k ON d.ecosystem = k.ecosystem AND contains(dependency, name)""")
def dependency_contains(spark, d):
    """Names within dependencies, by an index of grams: long and short names, common and unknown ones."""
    part = _read(spark, d, "part")
    k = F.col("p_partkey")
    declared = part.select("p_partkey", F.concat(F.lower(F.translate("p_type", " ", ".")), F.lit("."), k.cast("string")).alias("dependency"), F.concat(F.lit("e"), (F.col("p_size") % 3).cast("string")).alias("ecosystem"))
    name = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.lower(F.substring("p_type", 3, 6))).when(k % 5 == 2, (k % 90).cast("string")).when(k % 5 == 3, F.substring(F.lower("p_type"), 2, 2)).otherwise(F.concat(F.lit("none"), k.cast("string")))
    known = part.where("p_partkey % 20 < 5").select(F.concat(F.lit("e"), (k % 3).cast("string")).alias("ecosystem"), name.alias("name")).distinct().withColumn("mode", F.lit("contains"))
    return inventory.match_dependencies(declared, known).select("p_partkey", "name")


_RULE = r"regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1)"


@query(f"""WITH r AS (SELECT DISTINCT regexp_extract({_RULE}, '^[^/]*/[^/]*', 0) AS rule FROM pages WHERE page_id % 40 = 7 AND {_RULE} LIKE '%/%')
 SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_RULE} = rule OR starts_with({_RULE}, rule || '/'))""")
def rule_exclude(spark, d):
    """Pages below no rule, where the rules are a table that grows with the pages."""
    from quaymark.operators import path_rules

    path = F.regexp_extract("url", r"^https?://[^/?#]*/?([^?#]*)", 1)
    pages = _read(spark, d, "pages").select("page_id", path.alias("path"))
    rules = pages.where("page_id % 40 = 7 AND path LIKE '%/%'").select(F.concat(F.lit("./"), F.regexp_extract("path", "^[^/]*/[^/]*", 0), F.lit("/")).alias("rule"))
    return path_rules.not_excluded(pages, "path", rules, "rule").select("page_id")


@query(f"""WITH r AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN 'exclude' ELSE 'include' END AS kind, CASE page_id % 4 WHEN 0 THEN left({_PATH}, 5) || '*' || right({_PATH}, 2) WHEN 1 THEN 'GET ' || left({_PATH}, 4) || '?*[0-4]*' ELSE left({_PATH}, 6) || '[!a-m]*' END AS pat FROM pages WHERE page_id % 25 = 3)
 SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE kind = 'include' AND (({_PATH} GLOB pat) OR (('GET ' || {_PATH}) GLOB pat) OR (page_id::VARCHAR GLOB pat))) AND NOT EXISTS (SELECT 1 FROM r WHERE kind = 'exclude' AND (({_PATH} GLOB pat) OR (('GET ' || {_PATH}) GLOB pat) OR (page_id::VARCHAR GLOB pat))) THEN 'required' ELSE 'excluded' END AS scope FROM pages""")
def rule_scope(spark, d):
    """Scopes of pages by globs of a table that grows with the pages."""
    from quaymark.operators import path_rules

    pages = _read(spark, d, "pages").select("page_id", F.lit("GET").alias("method"), F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1).alias("path"))
    k = F.col("page_id")
    glob = F.when(k % 4 == 0, F.concat(F.left("path", F.lit(5)), F.lit("*"), F.right("path", F.lit(2)))).when(k % 4 == 1, F.concat(F.lit("GET "), F.left("path", F.lit(4)), F.lit("?*[0-4]*"))).otherwise(F.concat(F.left("path", F.lit(6)), F.lit("[!a-m]*")))
    rules = pages.where("page_id % 25 = 3").select(F.when(k % 3 == 0, "exclude").otherwise("include").alias("kind"), glob.alias("glob")).distinct()
    return path_rules.scopes(pages, "page_id", rules)


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, max(CASE l_returnflag WHEN 'R' THEN 'integer' WHEN 'A' THEN 'string' END) AS t, bool_or(l_linestatus = 'O') AS r FROM lineitem GROUP BY 1, 2),
 o AS (SELECT l_orderkey, string_agg('"f' || l_linenumber || '":{' || coalesce('"type":"' || t || '"', '') || '}', ',' ORDER BY l_linenumber) AS props, string_agg(CASE WHEN r THEN '"f' || l_linenumber || '"' END, ',' ORDER BY l_linenumber) AS need FROM f GROUP BY 1)
 SELECT l_orderkey, '{"properties":{"id":{"type":"integer"},"lines":{"items":{"properties":{' || props || '},' || coalesce('"required":[' || need || '],', '') || '"type":"object"},"type":"array"}},"required":["id"],"type":"object"}' AS schema FROM o""")
def schema_fold(spark, d):
    """The fields that each order's lines read from a body, folded into one JSON schema an order."""
    from quaymark.operators import enrichment

    kind = F.when(F.col("l_returnflag") == "R", "integer").when(F.col("l_returnflag") == "A", "string")
    lines = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(kind).alias("type"), F.bool_or(F.col("l_linestatus") == "O").alias("required"))
    said = lambda t, r: F.to_json(F.struct(t.alias("type"), r.alias("required")))
    fields = lines.select("l_orderkey", F.concat(F.lit("lines.[].f"), F.col("l_linenumber").cast("string")).alias("name"), said(F.col("type"), F.col("required")).alias("value"), F.col("l_linenumber").alias("line"))
    ids_ = lines.select("l_orderkey").distinct().select("l_orderkey", F.lit("id").alias("name"), said(F.lit("integer"), F.lit(True)).alias("value"), F.lit(1).alias("line"))
    rows = fields.unionByName(ids_).select(F.lit("r").alias("repository_id"), F.col("l_orderkey").cast("string").alias("owner"), F.lit("POST").alias("method"), F.lit("request_field").alias("kind"), "name", "value", "line")
    return enrichment.body_schemas(rows).select(F.col("owner").cast("bigint").alias("l_orderkey"), "schema")


# Manifests ----------------------------------------------------------------------------------------

_MANIFESTS = ("composer.json", "package.json", "pom.xml", "App.csproj", "requirements.txt", "go.mod", "pubspec.yaml", "Gemfile", "pyproject.toml")


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS order_key, l_partkey::VARCHAR AS p, l_orderkey % 9 AS f FROM lineitem), b AS (SELECT *, order_key % 11 = 0 AND f NOT IN (4, 5, 6, 7) AS bad FROM i)
 SELECT DISTINCT order_key, CASE f WHEN 0 THEN 'composer' WHEN 1 THEN 'npm' WHEN 2 THEN 'maven' WHEN 3 THEN 'dotnet' WHEN 5 THEN 'go' WHEN 6 THEN 'dart' WHEN 7 THEN 'ruby' ELSE 'python' END AS ecosystem,
 CASE WHEN bad THEN NULL WHEN f = 0 THEN 'v/p' || p WHEN f = 1 THEN '@s/p' || p WHEN f = 2 THEN 'g:p' || p WHEN f = 3 THEN 'P.' || p WHEN f = 5 THEN 'h.io/p' || p WHEN f IN (6, 7) THEN 'p' || p ELSE 'p-' || p END AS dependency,
 CASE WHEN NOT bad THEN NULL WHEN f IN (0, 1) THEN 'JSONDecodeError' WHEN f IN (2, 3) THEN 'ParseError' ELSE 'TOMLDecodeError' END AS error FROM b""")
def manifest_dependencies(spark, d):
    """Each order as a manifest of its parts, in one of nine formats by key; some are cut off before their end, and parts may repeat."""
    from quaymark.functions import frames
    from quaymark.sources import manifests

    forms = (
        ('{{"name": "no", "require": {{{}}}}}', '"v/p<p>": "1"', ", "), ('{{"devDependencies": {{{}}}, "scripts": {{"no": "1"}}}}', '"@s/p<p>": "^1"', ", "),
        ("<project xmlns='u'><artifactId>no</artifactId><dependencies>{}</dependencies></project>", "<dependency><groupId>g</groupId><artifactId>p<p></artifactId></dependency>", ""),
        ("<Project><ItemGroup>{}<Reference Include='no'/></ItemGroup></Project>", "<PackageReference Include='P.<p>' Version='1'/>", ""), ("# no\n{}\n", "P_<p>>=1", "\n"), ("module h.io/no\nrequire (\n{}\n)\n", "\th.io/p<p> v1.0.<p>", "\n"),
        ("name: no\nenvironment:\n  sdk: x\ndependencies:\n{}\nflutter:\n  no: x\n", "  p<p>:\n    git: x", "\n"), ("source 'no'\n{}\n", "gem 'p<p>', '1'", "\n"), ('[project]\nname = "no"\ndependencies = [{}]', '"P_<p>>=1"', ", "),
    )
    lineitem = _read(spark, d, "lineitem")
    lines = frames.dealt(lineitem.select("l_orderkey", "l_partkey"), lineitem.count(), 250_000, "l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("parts"))
    text, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (frame, item, between) in enumerate(forms):
        head, tail = frame.format("\0").split("\0")
        before, *middle = item.split("<p>")
        said = F.transform("parts", lambda p: F.concat(F.lit(before), *[x for m in middle for x in (p, F.lit(m))]))  # noqa: B023
        whole = F.concat(F.lit(head), F.array_join(said, between), F.lit(tail))
        cut_off = whole if k in (4, 5, 6, 7) else F.when(F.col("l_orderkey") % 11 == 0, F.left(whole, F.length(whole) - 2)).otherwise(whole)
        here = F.col("l_orderkey") % len(forms) == k
        text, name = F.when(here, cut_off).otherwise(text), F.when(here, F.lit(_MANIFESTS[k])).otherwise(name)
    files = lines.select(F.lit("r").alias("repository_id"), F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), name).alias("path"), text.alias("text"))
    return manifests.manifest_dependencies(files).select(F.substring_index("path", "/", 1).cast("bigint").alias("order_key"), "ecosystem", "dependency", "error")
