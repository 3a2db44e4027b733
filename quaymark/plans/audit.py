"""From a source tree to endpoints, and from endpoints to a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.frames import cut
from quaymark.functions.ids import contract_id, endpoint_id
from quaymark.functions.paths import contract_path, path_shape, scope, split_url
from quaymark.operators import enrichment, gates
from quaymark.operators.extraction import extract, shared_facts
from quaymark.operators.inventory import SUPPORTED, detector_plan, histogram, language, merge_detections, technologies, unsupported
from quaymark.operators.merging import issue_category, merge_evidence
from quaymark.operators.wrappers import wrapped_calls
from quaymark.plans import render
from quaymark.plans.assembly import findings_documents, route_contracts, with_contracts
from quaymark.sources.files import repository_identity, tracked_files, unread, verify_snapshot
from quaymark.sources.manifests import manifest_dependencies
from quaymark.sources.tree import read_source_tree
from quaymark.sources.wsdl import resolve_contracts


def discover(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoints with merged evidence, unresolved rows) of files (repository_id, path, text)."""
    constants, fields = shared_facts(files)
    rows = extract(files, constants, fields)
    calls, functions = wrapped_calls(files)
    base, endpoint = split_url(F.col("url"))
    shown = calls.withColumn("base_url", base).withColumn("endpoint", endpoint)
    literals = {"kind": "endpoint", "detector": "php-curl", "direction": "consumed", "confidence": "confirmed", "code": None}
    rows = rows.unionByName(shown.select("repository_id", "path", *[F.lit(v).cast("string").alias(k) for k, v in literals.items()], "method", "base_url", "endpoint", "line", F.lit(0).alias("offset")))
    # What cURL is handed by a parameter is no open call where all callers say the URL.
    known = functions.where("whole").select("repository_id", "path", "first", "last")
    covered = [rows.repository_id == known.repository_id, rows.path == known.path, rows.code == "php_curl_url_unresolved", rows.line.between(known["first"], known["last"])]
    rows = rows.join(known, covered, "left_anti")
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    order = F.concat(F.col("path"), F.lit("\u0001"), F.lpad(F.col("offset").cast("string"), 10, "0"))
    found = rows.where("kind = 'endpoint'").withColumn("evidence", place).withColumn("seen", order).withColumn("endpoint_id", endpoint_id(F.lit(None).cast("string"), F.col("direction"), F.col("method"), F.col("endpoint")))
    keys = ["repository_id", "endpoint_id", "detector", "direction", "method", "endpoint"]
    merged = merge_evidence(found, keys, "seen", "evidence", "confidence")
    # An address is told where all calls of an endpoint have the same one.
    bases = found.groupBy(*keys).agg(F.min("base_url").alias("base_url"), F.count_distinct("base_url").alias("n"))
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    told = merged.alias("m").join(bases.alias("b"), same, "left").select("m.*", F.when(F.col("b.n") == 1, F.col("b.base_url")).alias("base_url"))
    return told.withColumnRenamed("endpoint", "path"), rows.where("kind = 'unresolved'").select("repository_id", "path", "detector", "code", "line").distinct()


def unsupported_technologies(found: DataFrame) -> DataFrame:
    """Issue rows for detected frameworks and clients without a detector, and integration surfaces other than SOAP."""
    known = found.sparkSession.createDataFrame([(x,) for x in SUPPORTED], "name string")
    code = F.when(F.col("kind") == "integration", "unsupported_integration_surface").when(F.col("kind") == "http_client", "unsupported_http_client").otherwise("unsupported_framework")
    open_ = unsupported(found.where("kind <> 'existing_spec'"), known, "name")
    return open_.groupBy("repository_id", "name", "kind").agg(F.min("path").alias("path")).select("repository_id", "path", F.col("name").alias("detector"), code.alias("code"), F.lit(None).cast("int").alias("line"))


def zero_hits(found: DataFrame, endpoints: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Issue rows for supported technologies whose detector gave neither an endpoint nor an open call."""
    seen = endpoints.select("repository_id", F.col("detector").alias("name")).union(unresolved.select("repository_id", "detector")).distinct()
    silent = found.where(F.col("name").isin(*SUPPORTED)).groupBy("repository_id", "name").agg(F.min("path").alias("path")).join(seen, ["repository_id", "name"], "left_anti")
    return silent.select("repository_id", "path", F.col("name").alias("detector"), F.lit("detector_without_hits").alias("code"), F.lit(None).cast("int").alias("line"))


def audit(spark: SparkSession, root: str, ref: str = "HEAD", repository_id: str | None = None, exclude: tuple[str, ...] = (), require_correlation: bool = False) -> dict[str, DataFrame]:
    """Inventory, detector plan, dependencies, endpoints with contracts, body schemas, behaviour, unresolved rows, status and findings of one pinned work tree."""
    snapshot = verify_snapshot(root, ref)
    name, _ = repository_identity(root, repository_id)
    # Every file is read once; what is made of them reads the rows that are kept.
    entries = cut(read_source_tree(spark, root, name, exclude=exclude))
    files = entries.where("kind = 'file'").drop("kind")
    passed = entries.where("kind <> 'file'").select("repository_id", "path", "kind")
    languages = histogram(files.select(language(F.col("path")).alias("language"), "path").where("language IS NOT NULL"), "language", "path")
    # Each is used by several results: files are read and scanned once for each kind of row.
    found = cut(technologies(files))
    endpoints, calls = discover(files)
    endpoints, calls, facts = cut(endpoints), cut(calls), enrichment.facts(files)
    place = endpoints.where("detector = 'soap'").select("repository_id", F.col("method").alias("operation"), F.col("path").alias("target"), F.explode("evidence").alias("e"))
    integrations = place.select("repository_id", F.substring_index("e", ":", 1).alias("path"), F.substring_index("e", ":", -1).cast("int").alias("line"), "operation", "target")
    facts = cut(enrichment.laid_onto_routes(facts, integrations))
    behaviours = cut(enrichment.behaviour(facts))
    endpoints = cut(with_contracts(endpoints, route_contracts(facts, behaviours)))
    not_read, no_detector, silent = unread(files), unsupported_technologies(found), zero_hits(found, endpoints, calls)
    operations = endpoints.where("detector = 'soap'").select("repository_id", F.col("method").alias("operation"), F.col("path").alias("wsdl"), F.substring_index(F.element_at("evidence", 1), ":", 1).alias("path"))
    missing = resolve_contracts(operations, files, tracked_files(spark, root, name)).where(~F.col("defined_in_wsdl"))
    soap = missing.select("repository_id", "path", F.lit("soap").alias("detector"), F.concat(F.lit("soap_contract_"), F.col("wsdl_status")).alias("code"), F.lit(None).cast("int").alias("line"))
    inside = facts.where("kind = 'unresolved'").select("repository_id", "path", F.lit("slim").alias("detector"), F.col("name").alias("code"), "line")
    handed = behaviours.where("kind = 'unresolved'").select("repository_id", F.col("owner").alias("path"), F.lit("slim").alias("detector"), F.col("name").alias("code"), F.lit(None).cast("int").alias("line"))
    parts = {"discovery": calls, "inventory": not_read, "unsupported": no_detector, "silent": silent, "soap": soap, "body": inside, "helper": handed.where(F.col("code").contains("helper"))}
    unresolved = None
    for source, rows in parts.items():
        rows = rows.withColumn("source", F.lit(source))
        unresolved = rows if unresolved is None else unresolved.unionByName(rows)
    unresolved = cut(unresolved.distinct().withColumn("category", F.when(F.col("source") == "inventory", "inventory").otherwise(issue_category(F.col("code")))))
    # One row of counts, joined by the one repository.
    counts = unresolved.agg(*[F.count_if(F.col("source") == x).alias(x) for x in parts], F.count("*").alias("open")).withColumn("repository_id", F.lit(name))
    exposed = (F.col("direction") == "exposed")
    sides = endpoints.agg(F.count_if(exposed).alias("exposed"), F.count_if(exposed & (F.col("contract.contract_status") != "complete")).alias("pending"), F.count_if(~exposed).alias("consumed")).withColumn("repository_id", F.lit(name))
    contracts, correlation = gates.contract_scope(F.col("exposed"), F.col("pending"), F.col("body")), gates.correlation_scope(F.col("consumed"), F.lit(require_correlation))
    facts_ = {k: F.lit(v).alias(k) for k, v in snapshot.items() if k != "root"}
    state = counts.join(sides, "repository_id").withColumn("contract_scope", contracts).withColumn("correlation_scope", correlation)
    status = gates.audit_gate(F.col("inventory") == 0, (F.col("discovery") + F.col("silent")) == 0, F.lit(0), F.col("unsupported"), F.col("soap") + F.col("body") + F.col("helper"), F.col("contract_scope"), F.col("correlation_scope"))
    state = cut(state.select("repository_id", *facts_.values(), "open", "contract_scope", "correlation_scope", status.alias("status")))
    return {
        "inventory": languages, "passed_over": passed, "technologies": merge_detections(found.withColumn("confidence", F.lit("confirmed")), "path"), "plan": detector_plan(found), "dependencies": manifest_dependencies(files), "endpoints": endpoints,
        "bodies": cut(enrichment.route_bodies(facts)), "behaviour": behaviours, "unresolved": unresolved.drop("source"), "status": state, "findings": findings_documents(endpoints, state),
        "knowledge": render.knowledge_lines(endpoints), "report": render.report_lines(state, endpoints, unresolved),
    }


def catalog(endpoints: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Canonical endpoints: path, shape, contract id and scope."""
    path = contract_path(F.col("path"))
    rows = endpoints.withColumn("normalized_path", path).withColumn("path_shape", path_shape(path)).withColumn("method", F.upper("method"))
    rows = rows.withColumn("contract_endpoint_id", contract_id(F.col("direction"), F.col("method"), F.col("path_shape")))
    return rows.withColumn("scope", scope(F.col("contract_endpoint_id"), F.col("method"), F.col("normalized_path"), include, exclude))
