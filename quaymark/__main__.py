"""Command line: ``python -m quaymark inventory|discover|audit|correlate|catalog|compare|check ...``.

Exits 0 when done, 2 on an error, 3 on a partial audit or a failed gate.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import compatibility, consumption, correlation
from quaymark.plans import pages
from quaymark.plans.assembly import catalog_documents, with_evidence
from quaymark.plans.audit import audit, catalog
from quaymark.sources.documents import endpoints, input_records, read_catalogs, read_findings
from quaymark.sources.publish import publish, require_set

VERBS = ("inventory", "discover", "audit", "correlate", "catalog", "compare", "check")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quaymark")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("inventory", "discover", "audit"):
        p = verbs.add_parser(name)
        p.add_argument("root")
        p.add_argument("--ref", default="HEAD")
        p.add_argument("--repository-id")
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--require-correlation", action="store_true")
        p.add_argument("--output")
    p = verbs.add_parser("correlate")
    p.add_argument("--findings", action="append", required=True)
    p.add_argument("--output")
    p = verbs.add_parser("catalog")
    p.add_argument("--findings", required=True)
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--output")
    for name, sides in (("compare", ("reference", "candidate")), ("check", ("consumers", "providers"))):
        p = verbs.add_parser(name)
        for side in sides:
            p.add_argument(f"--{side}", required=True)
        p.add_argument("--gate", choices=("report", "breaking", "strict"), default="report")
        p.add_argument("--enforce-security-policy", action="store_true")
        p.add_argument("--output")
    return top


def give(spark: SparkSession, output: str | None, parts: dict[str, DataFrame], pages: Callable[[], dict[str, DataFrame]] | None = None) -> None:
    if output:
        publish(spark, output, parts, check=lambda staging: require_set(spark, staging, list(parts)), pages=pages() if pages else None)
        return
    for df in parts.values():
        for line in df.toJSON().toLocalIterator():
            print(line)


def _evidence(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The evidence of each endpoint id, once."""
    return rows.select(F.col("endpoint_id").alias(key), F.col("evidence").alias(name)).dropDuplicates([key])


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.verb in ("inventory", "discover", "audit"):
        found = audit(spark, a.root, a.ref, a.repository_id, tuple(a.exclude), a.require_correlation)
        parts = {"inventory": ("inventory", "technologies", "plan", "dependencies"), "discover": ("endpoints", "unresolved"), "audit": tuple(found)}[a.verb]
        give(spark, a.output, {k: found[k] for k in parts}, (lambda: pages.audit_pages(found)) if a.verb == "audit" else None)
        return 3 if a.verb == "audit" and found["status"].first().status != "complete" else 0
    if a.verb == "correlate":
        rows = catalog(endpoints(read_findings(spark, a.findings)))
        keys, consumed, exposed = ["method", "path_shape"], rows.where("direction = 'consumed'"), rows.where("direction = 'exposed'")
        found = correlation.correlate(consumed, exposed, keys, "endpoint_id", "endpoint_id", "provider_repository", ["repository_id"])
        coverage = correlation.coverage(found)
        shown = found.join(_evidence(consumed, "endpoint_id", "consumer_evidence"), "endpoint_id", "left").join(_evidence(exposed, "provider", "provider_evidence"), "provider", "left").orderBy("status", *keys, "endpoint_id")
        give(spark, a.output, {"correlations": shown, "coverage": coverage}, lambda: pages.correlation_page(found, coverage, "endpoint_id", keys))
        return 0
    if a.verb == "catalog":
        rows = endpoints(read_findings(spark, [a.findings]))
        give(spark, a.output, {"catalog": catalog_documents(rows, tuple(a.include), tuple(a.exclude)), "inputs": input_records(spark, [a.findings])})
        return 0
    sides = [endpoints(read_catalogs(spark, [p])) for p in ((a.reference, a.candidate) if a.verb == "compare" else (a.consumers, a.providers))]
    if a.verb == "compare":
        from quaymark.operators.merging import require_unique

        keys = ["direction", "method", "path_shape"]
        for side in sides:
            require_unique(side, keys)
        rows = with_evidence(compatibility.compare_contracts(*sides, keys, a.enforce_security_policy), sides, keys).orderBy("method", "path_shape", "direction")
        found, breaking, unknown = compatibility.summary(rows), F.col("breaking") > 0, F.col("unknown") > 0
        shown = lambda: pages.compatibility_page(rows, found, ["method", "path_shape", "direction"])
    else:
        consumed = sides[0].where("direction = 'consumed'")
        rows = consumption.check_consumers(consumed, sides[1].where("direction = 'exposed'"), ["method", "path_shape"], "endpoint_id", a.enforce_security_policy)
        rows = rows.join(_evidence(consumed, "endpoint_id", "evidence"), "endpoint_id", "left").orderBy("method", "path_shape", "endpoint_id")
        found, breaking, unknown = consumption.summary(rows), (F.col("breaking") > 0) | (F.col("missing") > 0), (F.col("unknown") > 0) | (F.col("ambiguous") > 0)
        shown = lambda: pages.consumer_page(rows, found, ["method", "path_shape"])
    found = found.withColumn("gate", compatibility.gate(a.gate, breaking, unknown))
    given = [a.reference, a.candidate] if a.verb == "compare" else [a.consumers, a.providers]
    give(spark, a.output, {"records": rows, "summary": found, "inputs": input_records(spark, given)}, shown)
    return 3 if found.first().gate == "failed" else 0


def main(arguments: list[str] | None = None) -> int:
    given = list(sys.argv[1:] if arguments is None else arguments)
    if given and given[0] not in VERBS and not given[0].startswith("-"):
        given = ["audit", *given]
    a = parser().parse_args(given)
    spark = SparkSession.builder.appName("quaymark").getOrCreate()
    try:
        return run(spark, a)
    except (ValueError, OSError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
