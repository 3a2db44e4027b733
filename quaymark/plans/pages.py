"""Whole pages: the lines of a report below its head, with the order in which they stand in a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.plans import render


def page(head: list[str], *bodies: DataFrame) -> DataFrame:
    """part, section, position and line: the head first, then each body (section, position, line) in turn."""
    spark = bodies[0].sparkSession
    rows = spark.createDataFrame([(0, "", k, x) for k, x in enumerate(head)], "part int, section string, position int, line string")
    for k, body in enumerate(bodies):
        rows = rows.unionByName(body.select(F.lit(k + 1).alias("part"), "section", F.col("position").cast("int").alias("position"), "line"))
    return rows


def audit_pages(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """An audit's three pages; each has the audit's repository, commit and status in its head."""
    state = found["status"].first()
    said = {"repository": state.repository_id, "source_commit": state.source_commit, "status": state.status}
    front = render.front_matter(said).rstrip("\n").split("\n")
    exposed = found["endpoints"].where("direction = 'exposed'")
    paths = "paths:" if not exposed.isEmpty() else "paths: {}"
    api = ["openapi: 3.1.0", "info:", f'  title: "{state.repository_id} API"', f'  version: "{state.source_commit[:12]}"', f"x-contract-scope: {state.contract_scope}", paths]
    return {"audit-report.md": page(front, found["report"]), "api-knowledge.md": page([*front, "# Endpoints"], found["knowledge"]), "openapi.yaml": page(api, render.openapi_lines(found["endpoints"], found["bodies"]))}


def correlation_page(correlated: DataFrame, coverage: DataFrame, consumer_id: str, keys: list[str]) -> dict[str, DataFrame]:
    counted = coverage.first().asDict()
    head = ["# Who calls whom", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in counted.items()], "", "| " + " | ".join(["status", "consumer", *keys, "candidates", "provider"]) + " |", "|" + "-|" * (len(keys) + 4)]
    return {"correlations.md": page(head, render.correlation_lines(correlated, consumer_id, keys))}


def compatibility_page(compared: DataFrame, summary: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    counted = summary.first().asDict()
    return {"compatibility.md": page(["# What changed", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in counted.items()], ""], render.compatibility_lines(compared, keys))}


def consumer_page(checked: DataFrame, summary: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    counted = summary.first().asDict()
    shown = checked.withColumnsRenamed({"checks": "findings", "status": "classification"})
    return {"consumers.md": page(["# What consumers need", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in counted.items()], ""], render.compatibility_lines(shown, keys))}
