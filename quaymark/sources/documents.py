"""Versioned JSON documents: findings and catalogs, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.frames import cut
from quaymark.functions.trees import document_digests
from quaymark.operators.compatibility import CONTRACT
from quaymark.operators.merging import snapshot_conflicts
from quaymark.operators.schema_rules import document_violations
from quaymark.operators.validation import Invalid

FINDINGS_VERSION, CATALOG_VERSION = "2.0", "1.0"
EVIDENCE = "array<struct<path:string,line:int,end_line:int,symbol:string,kind:string,note:string>>"
ENDPOINT = (
    "struct<endpoint_id:string,direction:string,method:string,path:string,base_url:string,api_id:string,api_name:string,provider_repository:string,consumer_repository:string,"
    f"handler:string,confidence:string,contract_status:string,semantic_status:string,evidence:{EVIDENCE},notes:array<string>,contract:{CONTRACT}>"
)
FINDINGS = f"schema_version string, audit_id string, repository string, repository_id string, source_ref string, source_commit string, status string, audit_timestamp string, endpoints array<{ENDPOINT}>"
CATALOG = f"schema_version string, catalog_id string, repository_id string, source_commit string, endpoints array<struct<endpoint_id:string,source_endpoint_id:string,direction:string,method:string,normalized_path:string,path_shape:string,confidence:string,scope:string,evidence:{EVIDENCE},contract:{CONTRACT}>>"
_WORD, _MAYBE = {"type": "string", "minLength": 1}, {"type": ["string", "null"]}
_PLACE = {"type": "object", "required": ["path"], "properties": {"path": _WORD, "line": {"type": ["integer", "null"], "minimum": 1}, "end_line": {"type": ["integer", "null"], "minimum": 1}}}
_SHARED = {
    "direction": {"enum": ["consumed", "exposed"]}, "method": _WORD, "confidence": {"enum": ["confirmed", "probable", "unresolved"]}, "evidence": {"type": "array", "items": {"$ref": "#/$defs/place"}},
    "contract": {"type": ["object", "null"], "properties": {"contract_status": {"enum": ["complete", "partial", "unresolved", "unknown", None]}, "request": {"type": ["object", "null"]}, "response": {"type": ["object", "null"]}, "parameters": {"type": ["object", "null"]}}},
}
#: What a findings document must be; more keys may be there.
FINDINGS_SCHEMA = {
    "type": "object", "required": ["schema_version", "repository_id", "source_commit", "status", "audit_timestamp", "endpoints"],
    "properties": {
        "schema_version": {"const": FINDINGS_VERSION}, "repository_id": _WORD, "source_commit": {"type": "string", "pattern": "^[0-9a-f]{7,64}$"}, "status": {"enum": ["complete", "partial", "failed"]},
        "audit_timestamp": {"type": "string", "format": "date-time"}, "endpoints": {"type": "array", "items": {"$ref": "#/$defs/endpoint"}},
    },
    "$defs": {"place": _PLACE, "endpoint": {"type": "object", "required": ["endpoint_id", "direction", "method", "path", "confidence"], "properties": _SHARED | {"endpoint_id": _WORD, "path": {"type": "string"}, "base_url": _MAYBE, "notes": {"type": "array", "items": {"type": "string"}}}}},
}
CATALOG_SCHEMA = {
    "type": "object", "required": ["schema_version", "repository_id", "endpoints"], "properties": {"schema_version": {"const": CATALOG_VERSION}, "repository_id": _WORD, "endpoints": {"type": "array", "items": {"$ref": "#/$defs/endpoint"}}},
    "$defs": {"place": _PLACE, "endpoint": {"type": "object", "required": ["endpoint_id", "direction", "method", "path_shape"], "properties": _SHARED | {"endpoint_id": _WORD, "path_shape": {"type": "string"}, "scope": {"enum": ["required", "excluded", "unclassified", None]}}}},
}


def read_documents(spark: SparkSession, paths: list[str], schema: str, rules: dict) -> DataFrame:
    """JSON documents, a whole file or one a line; a file that breaks its JSON schema is an error before anything else runs."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("source_file"), "value")
    one = F.when(F.try_parse_json("value").isNotNull(), F.array("value")).otherwise(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
    texts = files.select("source_file", F.explode(one).alias("document"))
    broken = document_violations(texts, "source_file", "document", rules).limit(5).collect()
    if broken:
        raise Invalid("; ".join(f"{r.source_file}: {r.path} breaks {r.rule}" for r in broken))
    return texts.select(F.from_json("document", schema).alias("d"), "source_file", "document").select("d.*", "source_file", "document")


def once_each(documents: DataFrame) -> DataFrame:
    """Documents that are equal as artifacts count once; a repository with several commits or contents is an error."""
    marked = document_digests(documents.withColumn("_k", F.monotonically_increasing_id()), "_k", "document")
    rows = cut(documents.withColumn("_k", F.monotonically_increasing_id()).join(marked, "_k"))
    conflicts = snapshot_conflicts(rows, "repository_id", "source_commit", "digest").limit(3).collect()
    if conflicts:
        raise Invalid("; ".join(f"{r.repository_id}: {r.conflict}" for r in conflicts))
    return rows.dropDuplicates(["repository_id"]).drop("_k", "digest")


def read_findings(spark: SparkSession, paths: list[str]) -> DataFrame:
    return once_each(read_documents(spark, paths, FINDINGS, FINDINGS_SCHEMA)).drop("document")


def read_catalogs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return read_documents(spark, paths, CATALOG, CATALOG_SCHEMA).drop("document")


def input_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of each input file: what a result was made from."""
    rows = spark.read.format("binaryFile").load(paths)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"))


def endpoints(documents: DataFrame) -> DataFrame:
    """One row for each endpoint, with its document's repository and commit."""
    return documents.select("repository_id", "source_commit", F.explode("endpoints").alias("e")).select("repository_id", "source_commit", "e.*")
