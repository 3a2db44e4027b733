"""WSDL contracts and the SOAP operations that meet them."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "repository_id string, path string, operation string, service string, port string, binding string, input string, output string, error string"


def operations(text: str) -> list[tuple[str, str | None, str | None, str | None, str | None, str | None]]:
    """(operation, service, port, binding, input, output) of a file's first service."""
    root = ElementTree.fromstring(text)
    tag = lambda e: e.tag.rpartition("}")[2]
    plain = lambda x: (x or "").rpartition(":")[2] or None
    service = next((e for e in root.iter() if tag(e) == "service"), None)
    port = next((e for e in service if tag(e) == "port"), None) if service is not None else None
    found = []
    for kind in (e for e in root if tag(e) == "portType"):
        for op in (e for e in kind if tag(e) == "operation"):
            ends = {tag(e): plain(e.get("message")) for e in op if tag(e) in ("input", "output")}
            found.append((op.get("name"), service.get("name") if service is not None else None, port.get("name") if port is not None else None, plain(port.get("binding")) if port is not None else None, ends.get("input"), ends.get("output")))
    return found


def read_contracts(files: DataFrame) -> DataFrame:
    """Operations of all .wsdl files among files (repository_id, path, text); an unreadable or empty one gives a row with an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for repository, path, text in zip(frame["repository_id"], frame["path"], frame["text"], strict=True):
                try:
                    own = operations(text or "")
                    out += [(repository, path, *o, None) for o in own] or [(repository, path, *[None] * 6, "empty")]
                except ElementTree.ParseError:
                    out.append((repository, path, *[None] * 6, "invalid"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return files.where(F.lower("path").endswith(".wsdl")).select("repository_id", "path", "text").mapInPandas(run, ROWS)


def meet_contracts(calls: DataFrame, contracts: DataFrame, keys: list[str]) -> DataFrame:
    """Called operations with their contract and ``defined_in_wsdl``; what no contract has is false, not dropped."""
    known = contracts.where(F.col("operation").isNotNull()).dropDuplicates(keys).withColumn("_hit", F.lit(True))
    return calls.join(known, keys, "left").withColumn("defined_in_wsdl", F.col("_hit").isNotNull()).drop("_hit")


def local_path(wsdl: Column, source: Column) -> tuple[Column, Column]:
    """A WSDL's place in the repository as written, and as written from the folder of the file that names it; null if remote or outside."""
    plain = F.regexp_replace(F.regexp_replace(wsdl, r"^(\./)+", ""), r"^/+", "")
    folder = F.when(F.instr(source, "/") > 0, F.regexp_replace(source, "[^/]*$", "")).otherwise("")
    beside = F.concat(folder, plain)
    while_up = r"(^|/)(?!\.\.)[^/]+/\.\./"
    for _ in range(8):
        beside = F.regexp_replace(beside, while_up, "$1")
    inside = lambda p: F.when(~wsdl.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~p.rlike(r"(^|/)\.\.(/|$)"), p)
    return inside(plain), inside(beside)


def resolve_contracts(calls: DataFrame, files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Called operations (repository_id, path, operation, wsdl) with their contract, ``defined_in_wsdl`` and ``wsdl_status``.

    A WSDL is looked up in the repository first, then beside the calling file, never over the network.
    Statuses: parsed, operation_missing, invalid, empty, untracked, missing, remote.
    """
    known = read_contracts(files)
    paths = known.groupBy("repository_id", F.col("path").alias("found")).agg(F.max("error").alias("error"))
    paths = paths.join(tracked.withColumnRenamed("path", "found").withColumn("tracked", F.lit(True)), ["repository_id", "found"], "left")
    first, second = local_path(F.col("wsdl"), F.col("path"))
    rows = calls.withColumn("_first", first).withColumn("_second", second)
    for name in ("_first", "_second"):
        rows = rows.join(paths.select("repository_id", F.col("found").alias(name), F.struct("found", "error", F.coalesce("tracked", F.lit(False)).alias("tracked")).alias(f"{name}_hit")), ["repository_id", name], "left")
    rows = rows.withColumn("hit", F.coalesce("_first_hit", "_second_hit"))
    contracts = known.where("operation IS NOT NULL").dropDuplicates(["repository_id", "path", "operation"]).select("repository_id", F.col("path").alias("wsdl_path"), "operation", "service", "port", "binding", "input", "output", F.lit(True).alias("_there"))
    rows = rows.withColumn("wsdl_path", F.when(F.col("hit.tracked"), F.col("hit.found"))).join(contracts, ["repository_id", "wsdl_path", "operation"], "left")
    status = (
        F.when(F.col("hit").isNull(), F.when(F.col("wsdl").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "remote").otherwise("missing"))
        .when(~F.col("hit.tracked"), "untracked").when(F.col("hit.error").isNotNull(), F.col("hit.error")).when(F.col("_there"), "parsed").otherwise("operation_missing")
    )
    return rows.withColumn("wsdl_status", status).withColumn("defined_in_wsdl", F.col("_there").isNotNull()).drop("_first", "_second", "_first_hit", "_second_hit", "hit", "_there")
