"""Reports as ordered lines. A report's lines stay rows, so that its size is no task's burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.paths import canonical_path, path_parameter_names, path_shape


class AmbiguousPath(ValueError):
    """One method has two source paths of one shape."""


def lines(rows: DataFrame, order: list[Column], *texts: Column) -> DataFrame:
    """(section, position, line): each row's lines in order; sections follow the order columns."""
    key = F.concat_ws("\u0001", *[c.cast("string") for c in order])
    return rows.select(key.alias("section"), F.posexplode(F.array_compact(F.array(*texts))).alias("position", "line"))


def joined(report: DataFrame) -> DataFrame:
    """One text for each section."""
    ordered = report.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    return ordered.select("section", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def grouped_paths(endpoints: DataFrame) -> DataFrame:
    """Endpoints by path shape: the canonical path, its methods in order, and how many source paths a method has."""
    each = endpoints.select(F.upper("method").alias("method"), "path").distinct().withColumn("shape", path_shape(F.col("path")))
    by_method = each.groupBy("shape", "method").agg(F.min("path").alias("path"), F.count("*").alias("paths"))
    return by_method.groupBy("shape").agg(F.min(canonical_path(F.col("path"))).alias("canonical"), F.array_sort(F.collect_list("method")).alias("methods"), F.max("paths").alias("paths_per_method"))


def require_distinct_paths(groups: DataFrame) -> None:
    found = groups.where("paths_per_method > 1").limit(1).collect()
    if found:
        raise AmbiguousPath(found[0].shape)


def openapi_lines(endpoints: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """An OpenAPI 3.1 document's ``paths`` as YAML lines by path: methods, ids, path parameters, bodies and statuses.

    ``bodies`` (method, path, content_type, schema as JSON, which is YAML too) may be left out, and so may the endpoints' ``contract``, which
    has the statuses. Where source paths of one method and shape differ in either, it is left out.
    """
    rows = endpoints.where(F.col("direction") == "exposed").withColumn("canonical", canonical_path(F.col("path"))).withColumn("method", F.lower("method"))
    # A path stands once, above its first method, with its source paths if they differ; a method stands once for a path.
    groups = rows.groupBy(F.col("canonical").alias("c")).agg(F.min("method").alias("first"), F.array_sort(F.collect_set("path")).alias("sources"))
    codes = F.transform(F.col("contract.response.status_codes"), lambda x: x.cast("string")) if "contract" in rows.columns else F.lit(None).cast("array<string>")
    if bodies is not None:
        asked = bodies.select(F.lower("method").alias("method"), canonical_path(F.col("path")).alias("canonical"), F.struct("content_type", "schema").alias("b"))
        asked = asked.groupBy("canonical", "method").agg(F.count_distinct("b").alias("bs"), F.min("b").alias("body")).where("bs = 1").drop("bs")
    rows = rows.groupBy("canonical", "method").agg(F.min("endpoint_id").alias("endpoint_id"), F.min("path").alias("path"), F.count_distinct(codes).alias("kinds"), F.min(codes).alias("codes"))
    rows = rows.join(groups, F.col("canonical") == F.col("c"))
    rows = rows.join(asked, ["canonical", "method"], "left") if bodies is not None else rows.withColumn("body", F.lit(None).cast("struct<content_type:string,schema:string>"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    body = F.concat(F.lit("      requestBody: {content: {"), quoted(F.col("body.content_type")), F.lit(": {schema: "), F.col("body.schema"), F.lit("}}}"))
    shown = F.when((F.col("kinds") == 1) & (F.size("codes") > 0), F.col("codes")).otherwise(F.array().cast("array<string>"))
    answers = F.array_join(F.concat(F.transform(F.array_sort(F.array_distinct(shown)), lambda x: F.concat(quoted(x), F.lit(": {description: shown}"))), F.array(F.lit("default: {description: not demonstrated}"))), ", ")
    top = F.col("method") == F.col("first")
    sources = F.when(top & (F.size("sources") > 1), F.concat(F.lit("    x-source-paths:\n"), F.array_join(F.transform("sources", lambda p: F.concat(F.lit("    - "), F.to_json(F.array(p)).substr(F.lit(2), F.length(F.to_json(F.array(p))) - 2))), "\n")))
    operation = F.concat(F.col("method"), F.left(F.sha2("endpoint_id", 256), F.lit(12)))
    n = F.size(path_parameter_names(F.col("path")))
    parameters = F.when(n > 0, F.concat(F.lit("      parameters:\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.lit("      - {name: param"), k.cast("string"), F.lit(", in: path, required: true, schema: {type: string}}"))), "\n")))
    return lines(
        rows, [F.col("canonical"), F.col("method")],
        F.when(top, F.concat(F.lit("  "), F.col("canonical"), F.lit(":"))), sources, F.concat(F.lit("    "), F.col("method"), F.lit(":")), F.concat(F.lit("      operationId: "), operation), parameters, body,
        F.concat(F.lit("      responses: {"), answers, F.lit("}")),
    )


def correlation_lines(correlated: DataFrame, consumer_id: str, keys: list[str]) -> DataFrame:
    """A Markdown report's table rows, by status."""
    cells = [F.col("status"), F.col(consumer_id).cast("string"), *[F.col(k).cast("string") for k in keys], F.col("candidate_count").cast("string"), F.coalesce(F.col("provider").cast("string"), F.lit("-"))]
    return lines(correlated, [F.col("status"), F.col(consumer_id)], F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def compatibility_lines(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Findings as Markdown bullets below their endpoint."""
    head = F.concat(F.lit("## "), F.concat_ws(" ", *keys), F.lit(": "), F.col("classification"))
    bullets = F.when(F.size("findings") > 0, F.array_join(F.transform("findings", lambda f: F.concat(F.lit("- "), f["classification"], F.lit(" "), f["code"], F.lit(" "), F.coalesce(f["detail"], F.lit("")))), "\n"))
    return lines(compared, [F.col(k) for k in keys], head, bullets)


def _listed(title: str, items: Column) -> Column:
    """``- title: a, b`` where there are items."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"- {title}: "), F.array_join(items, ", ")))


def _pairs(title: str, pairs: Column) -> Column:
    """``- title: key = value; ...`` of a map in order of its keys."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.when(F.size(pairs) > 0, F.concat(F.lit(f"- {title}: "), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" = "), F.coalesce(e["value"].cast("string"), F.lit("unknown")))), "; ")))


def knowledge_lines(endpoints: DataFrame) -> DataFrame:
    """A Markdown page's lines for each endpoint with its contract: tags, parameters, fields, answers, behaviour and evidence.

    ``endpoints``: direction, method, path, confidence, evidence (``path:line``) and contract. A fact that is not
    shown has no line; statuses always have one.
    """
    c = F.col("contract")
    request, response, behavior = c["request"], c["response"], c["behavior"]
    fields = F.transform(request["fields"], lambda f: F.concat(
        F.lit("| "), f, F.lit(" | "), F.coalesce(F.try_element_at(request["types"], f), F.lit("unknown")), F.lit(" | "),
        F.when(F.array_contains(request["required_fields"], f), "yes").when(F.array_contains(request["optional_fields"], f), "no").otherwise("unknown"), F.lit(" |"),
    ))
    table = F.when(F.size(fields) > 0, F.concat(F.lit("| field | type | required |\n|-|-|-|\n"), F.array_join(fields, "\n")))
    parameters = F.transform(F.array_sort(F.map_entries(c["parameters"])), lambda e: F.concat(e["key"], F.when(e["value"]["required"], " (required)").otherwise("")))
    tags = F.array_compact(F.array(F.col("direction"), F.lower("method"), F.when(F.size(behavior["side_effects"]) > 0, "side-effects"), F.when(F.size(behavior["internal"]) > 0, "reads-data"), F.when(c["authentication"]["authentication"].isNotNull(), "authenticated")))
    return lines(
        endpoints, [F.col("direction"), F.col("path"), F.col("method")],
        F.concat(F.lit("## "), F.col("method"), F.lit(" "), F.col("path")), F.concat(F.lit("- direction: "), F.col("direction"), F.lit(", confidence: "), F.coalesce("confidence", F.lit("unknown"))),
        F.concat(F.lit("- contract: "), F.coalesce(c["contract_status"], F.lit("unknown")), F.lit(", semantics: "), F.coalesce(c["semantic_status"], F.lit("unknown"))),
        _listed("tags", tags), _listed("parameters", parameters), table, _listed("status codes", F.transform(response["status_codes"], lambda x: x.cast("string"))), _listed("answers with", response["fields"]),
        F.when(c["authentication"]["authentication"].isNotNull(), F.concat(F.lit("- authentication: "), c["authentication"]["authentication"])),
        _pairs("side effects", behavior["side_effects"]), _listed("reads", behavior["internal"]), _pairs("conditions", behavior["response_semantics"]), _listed("evidence", F.col("evidence")),
    )


def report_lines(status: DataFrame, endpoints: DataFrame, unresolved: DataFrame) -> DataFrame:
    """An audit report's lines: verdict and scopes, numbers of endpoints by direction, and what is open, by code."""
    verdict = F.when(F.col("status") == "complete", "Everything that was found is covered.").otherwise("Something is open; see below.")
    head = lines(
        status, [F.lit("1")], F.concat(F.lit("# Audit of "), F.col("repository_id")), F.concat(F.lit("- commit: "), F.col("source_commit"), F.when(F.col("dirty"), " (work tree changed)").otherwise("")),
        F.concat(F.lit("- status: "), F.col("status"), F.lit(". "), verdict), F.concat(F.lit("- contracts: "), F.col("contract_scope"), F.lit(", correlation: "), F.col("correlation_scope")),
    )
    counted = endpoints.groupBy("direction").agg(F.count("*").alias("n"), F.count_if(F.col("contract.contract_status") == "complete").alias("known"))
    numbers = lines(counted, [F.lit("2"), F.col("direction")], F.concat(F.lit("- "), F.col("direction"), F.lit(": "), F.col("n").cast("string"), F.lit(", with a complete contract: "), F.col("known").cast("string")))
    issues = unresolved.groupBy("detector", "code").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("first"))
    place = F.concat(F.col("first.path"), F.coalesce(F.concat(F.lit(":"), F.col("first.line").cast("string")), F.lit("")))
    return head.unionByName(numbers).unionByName(lines(issues, [F.lit("3"), F.col("detector"), F.col("code")], F.concat(F.lit("- open: "), F.col("code"), F.lit(" ("), F.coalesce("detector", F.lit("-")), F.lit("), "), F.col("n").cast("string"), F.lit(", first at "), place)))


def front_matter(values: dict[str, str]) -> str:
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in values.items()) + "---\n"


def parse_front_matter(text: Column) -> Column:
    """A map of the ``key: value`` lines between a text's first two ``---`` lines."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))))
