"""Findings and catalogs as documents: what a source tree shows, in the form that the other verbs read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions.ids import contract_id
from quaymark.functions.paths import contract_path, path_shape, scope
from quaymark.operators.compatibility import CONTRACT
from quaymark.operators.enrichment import semantic_status as route_semantics
from quaymark.operators.projection import STATUS_NOTE, contract_status, requiredness, semantic_status, with_path_parameters
from quaymark.sources.documents import CATALOG_VERSION, ENDPOINT, EVIDENCE, FINDINGS_VERSION

ROUTE = ["repository_id", "owner", "method", "endpoint"]
SIDE_EFFECTS = ("outbound_http", "outbound_soap", "file_write", "mail")


def _named(kind: str, test: Column | None = None) -> Column:
    """Names of a route's facts of one kind, in order."""
    hit = F.col("kind") == kind
    return F.array_sort(F.collect_set(F.when(hit if test is None else hit & test, F.col("name"))))


def _types(kind: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("type").isNotNull(), F.struct("name", "type")))))


def route_contracts(facts: DataFrame, behaviours: DataFrame) -> DataFrame:
    """(repository_id, method, endpoint, contract, contract_note, semantics, open) of routes whose bodies were read.

    ``facts`` and ``behaviours`` come from ``operators.enrichment``. A contract is complete if no fact
    about it was left open. A route's facts are brought to one row for each name first.
    """
    shape = F.when(F.col("kind") == "request_field", F.get_json_object("value", "$.type")).when(F.col("kind") == "response_field", F.col("value"))
    need = F.when(F.col("kind") == "request_field", F.get_json_object("value", "$.required").cast("boolean"))
    one = facts.where("method IS NOT NULL").withColumn("type", shape).withColumn("need", need)
    # Uploads are fields of the request too.
    one = one.withColumn("upload", F.col("kind") == "multipart_field").withColumn("kind", F.when(F.col("upload"), "request_field").otherwise(F.col("kind"))).withColumn("type", F.when(F.col("upload"), "string").otherwise(F.col("type")))
    one = one.groupBy(*ROUTE, "kind", "name").agg(F.bool_or("upload").alias("upload"), F.min("type").alias("type"), F.bool_or("need").alias("need"), F.min("value").alias("value"))
    about = (F.col("kind") == "unresolved") & F.col("name").rlike("_(request|response|security)_")
    routes = one.groupBy(*ROUTE).agg(
        _named("request_field").alias("fields"), _named("request_field", F.col("need")).alias("required"), _named("request_field", ~F.col("need")).alias("optional"), _types("request_field").alias("request_types"),
        _named("response_field").alias("answers"), _types("response_field").alias("response_types"), F.transform(_named("status_code"), lambda x: x.cast("int")).alias("codes"),
        _named("query_parameter").alias("queries"), F.max(F.when(F.col("kind") == "authentication", F.struct("name", "value"))).alias("auth"), F.count_if(about).alias("open"), F.coalesce(F.bool_or("upload"), F.lit(False)).alias("uploads"),
    )
    effects = behaviours.where((F.col("kind").isin(*SIDE_EFFECTS)) | ((F.col("kind") == "data_access") & (F.col("value") == "write")))
    effects = effects.select("repository_id", "owner", F.concat_ws(":", "kind", "name").alias("k"), F.coalesce("value", F.lit("call")).alias("v")).distinct().groupBy("repository_id", "owner", "k").agg(F.min("v").alias("v"))
    effects = effects.groupBy("repository_id", "owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("side_effects"))
    states = behaviours.where("kind = 'condition' AND value IS NOT NULL").groupBy("repository_id", "owner", "name").agg(F.min("value").alias("value"))
    states = states.groupBy("repository_id", "owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("response_semantics"))
    read = behaviours.where("kind = 'data_access' AND value = 'read'").groupBy("repository_id", "owner").agg(F.array_sort(F.collect_set("name")).alias("internal"))
    semantics = route_semantics(behaviours).select("repository_id", "owner", F.col("status").alias("semantics"), "materiality")
    rows = routes
    for part in (effects, states, read, semantics):
        rows = rows.join(part, ["repository_id", "owner"], "left")
    required, optional, unknown = requiredness(F.col("fields"), F.col("required"), F.col("optional"))
    queries = F.map_from_entries(F.transform("queries", lambda q: F.struct(F.concat(F.lit("query:"), q).alias("k"), F.from_json(F.lit("{}"), "struct<required:boolean,type:string,format:string>").alias("v"))))
    json = F.lit("application/json")
    sent = F.when(F.col("uploads"), "multipart/form-data").when(F.size("fields") > 0, json)
    whole = F.to_json(F.struct(
        F.struct(F.col("fields"), required.alias("required_fields"), optional.alias("optional_fields"), unknown.alias("unknown_requiredness_fields"), sent.alias("content_type"), F.col("request_types").alias("types")).alias("request"),
        F.struct(F.col("answers").alias("fields"), F.when(F.size("codes") > 0, F.col("codes")).alias("status_codes"), F.when(F.size("answers") > 0, json).alias("content_type"), F.col("response_types").alias("types")).alias("response"),
        queries.alias("parameters"), F.struct(F.col("auth.name").alias("authentication"), F.col("auth.value").alias("credential_format")).alias("authentication"),
        F.struct("response_semantics", "side_effects", "internal").alias("behavior"),
    ))
    note = F.when(F.col("open") > 0, "partial").otherwise("complete")
    return rows.select("repository_id", "method", "endpoint", F.from_json(whole, CONTRACT).alias("contract"), note.alias("contract_note"), F.coalesce("semantics", F.lit("complete")).alias("semantics"), "materiality", "open")


def with_contracts(endpoints: DataFrame, contracts: DataFrame) -> DataFrame:
    """Endpoints with their contract, notes and statuses; what no body shows has an unknown contract, with its path's parameters."""
    held = contracts.groupBy("repository_id", "method", F.col("endpoint").alias("path")).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("contract", "contract_note", "semantics", "materiality")])
    rows = endpoints.join(held, ["repository_id", "method", "path"], "left")
    # Two bodies for one route leave its contract open.
    note = F.when(F.col("direction") != "exposed", F.lit(None)).when(F.col("_n").isNull(), "unresolved").when(F.col("_n") > 1, "partial").otherwise(F.col("contract_note"))
    empty = F.from_json(F.lit('{"request":{},"response":{},"authentication":{},"behavior":{}}'), CONTRACT)
    rows = rows.withColumn("notes", F.when(note.isNotNull(), F.array(F.concat(F.lit(f"{STATUS_NOTE}="), note))).otherwise(F.array().cast("array<string>")))
    known = F.when((F.col("direction") == "exposed") & (F.col("_n") == 1), F.col("contract")).otherwise(empty)
    whole = known.withField("parameters", with_path_parameters(known["parameters"], F.col("path"))).withField("contract_status", contract_status(F.col("notes"))).withField("semantic_status", semantic_status(F.col("semantics")))
    whole = whole.withField("materiality", F.when((F.col("_n") == 1) & (F.col("semantics") == "partial"), F.col("materiality")))
    return rows.withColumn("contract", whole).drop("_n", "contract_note", "semantics", "materiality")


def findings_documents(endpoints: DataFrame, status: DataFrame, audited_at: Column | None = None) -> DataFrame:
    """One findings document for each repository: its endpoints in order, with evidence and contracts.

    A document is one row, as it is one file; it must fit a task.
    """
    place = F.transform("evidence", lambda e: F.struct(F.substring_index(e, ":", 1).alias("path"), F.substring_index(e, ":", -1).cast("int").alias("line")))
    empty = lambda name: F.lit(None).cast("string").alias(name)
    values = {
        "evidence": F.from_json(F.to_json(place), EVIDENCE), "contract_status": F.col("contract.contract_status"), "semantic_status": F.col("contract.semantic_status"),
    }
    have = {"base_url", "endpoint_id", "direction", "method", "path", "confidence", "notes", "contract"}
    names = [x.name for x in endpoints.sparkSession.createDataFrame([], f"e {ENDPOINT}").schema["e"].dataType.fields]
    one = F.struct(*[values[n].alias(n) if n in values else F.col(n) if n in have else empty(n) for n in names])
    sort_key = F.concat_ws("\u0001", "direction", "method", "path", "endpoint_id")
    by = endpoints.groupBy("repository_id").agg(F.collect_list(F.struct(sort_key.alias("k"), one.alias("e"))).alias("all"))
    ordered = F.transform(F.array_sort("all", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda x: x["e"])
    at = audited_at if audited_at is not None else F.current_timestamp()
    rows = status.join(by, "repository_id", "left").withColumn("endpoints", F.coalesce(ordered, F.array().cast(f"array<{ENDPOINT}>")))
    return rows.select(
        F.lit(FINDINGS_VERSION).alias("schema_version"), F.concat(F.lit("audit-"), F.left(F.sha2(F.concat_ws("|", "repository_id", "source_commit"), 256), F.lit(20))).alias("audit_id"), F.col("repository_id").alias("repository"), "repository_id",
        F.lit("HEAD").alias("source_ref"), "source_commit", "status", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("audit_timestamp"), "endpoints",
    )


def catalog_documents(rows: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """One catalog document for each repository from endpoints (as ``sources.documents.endpoints`` gives them), in order."""
    path = contract_path(F.col("path"))
    shape = path_shape(path)
    own = rows.withColumn("method", F.upper("method")).withColumn("normalized_path", path).withColumn("path_shape", shape)
    own = own.withColumn("source_endpoint_id", F.col("endpoint_id")).withColumn("endpoint_id", contract_id(F.col("direction"), F.col("method"), F.col("path_shape")))
    own = own.withColumn("scope", scope(F.col("source_endpoint_id"), F.col("method"), F.col("normalized_path"), include, exclude))
    own = own.withColumn("contract", F.col("contract").withField("parameters", with_path_parameters(F.col("contract.parameters"), F.col("normalized_path"))))
    one = F.struct("endpoint_id", "source_endpoint_id", "direction", "method", "normalized_path", "path_shape", "confidence", "scope", "evidence", "contract")
    key = F.concat_ws("\u0001", "direction", "method", "path_shape", "source_endpoint_id")
    by = own.groupBy("repository_id", "source_commit").agg(F.collect_list(F.struct(key.alias("k"), one.alias("e"))).alias("all"))
    ordered = F.transform(F.array_sort("all", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda x: x["e"])
    return by.select(F.lit(CATALOG_VERSION).alias("schema_version"), F.concat(F.lit("catalog-"), F.left(F.sha2(F.concat_ws("|", "repository_id", "source_commit"), 256), F.lit(20))).alias("catalog_id"), "repository_id", "source_commit", ordered.alias("endpoints"))


def with_evidence(records: DataFrame, sides: list[DataFrame], keys: list[str]) -> DataFrame:
    """Records with the evidence of both sides, the first side's first."""
    held = None
    for k, side in enumerate(sides):
        rows = side.select(*keys, F.lit(k).alias("side"), F.posexplode("evidence").alias("at", "e"))
        held = rows if held is None else held.unionByName(rows)
    lists = held.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "at", "e"))), lambda x: x["e"]).alias("evidence"))
    return records.join(lists, keys, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(lists.schema["evidence"].dataType)))
