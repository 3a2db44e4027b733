"""Results published as a whole or not at all: written beside the target, checked, then renamed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quaymark.functions import digests, nested
from quaymark.functions.text import redact, secret_like
from quaymark.sources.ordered import write_lines


class SecretFound(ValueError):
    """A result still holds something like a credential."""


def redacted(df: DataFrame) -> DataFrame:
    """Every string with its secrets hidden, in structs, arrays, and keys and values of maps too."""
    return nested.mapped(df, redact)


def require_no_secrets(df: DataFrame) -> None:
    """No string of any depth holds a credential that is not hidden."""
    if not nested.rows_with(df, secret_like).isEmpty():
        raise SecretFound("unhidden credential in a result")


class NotWhole(ValueError):
    """A published set lacks a part, or its parts do not belong together."""


def require_set(spark: SparkSession, folder: str, parts: list[str], same: tuple[str, ...] = ("repository_id", "source_commit"), format: str = "json") -> None:
    """All parts are there, and the parts that name a repository and commit name the same ones."""
    names = None
    for part in parts:
        try:
            rows = spark.read.format(format).load(f"{folder}/{part}")
        except Exception as problem:
            if "UNABLE_TO_INFER_SCHEMA" in str(problem):  # a part without rows
                continue
            raise NotWhole(f"{part} cannot be read") from problem
        if set(same) <= set(rows.columns):
            own = rows.select(*[F.col(c).cast("string").alias(c) for c in same])
            names = own if names is None else names.union(own)
    if names is not None and names.distinct().limit(2).count() > 1:
        raise NotWhole(f"parts differ in {' or '.join(same)}")


#: The part of a published set that says what the others are.
MANIFEST = "manifest"


def require_manifest(spark: SparkSession, folder: str) -> list[str]:
    """The names of a published set's parts, each of which has the rows that its manifest states."""
    try:
        stated = spark.read.schema("part string, format string, schema string, rows bigint, digest string").json(f"{folder}/{MANIFEST}").collect()
    except Exception as problem:
        raise NotWhole("the manifest cannot be read") from problem
    if not stated:
        raise NotWhole("the manifest is empty")
    for part in stated:
        try:
            rows = spark.read.format(part.format).schema(StructType.fromJson(json.loads(part.schema))).load(f"{folder}/{part.part}")
            found = digests.set_digest(rows, []).first()
        except Exception as problem:
            raise NotWhole(f"{part.part} cannot be read") from problem
        if (found["rows"], found["digest"]) != (part["rows"], part["digest"]):
            raise NotWhole(f"{part.part} does not have the rows that were written")
    return [p.part for p in stated]


def write_part(folder: str, name: str, df: DataFrame, format: str) -> tuple[str, str, str, int, str]:
    """Write one part and give its row of the manifest; its sums are taken while it is written."""
    seen = Observation(f"part {name}")
    sums = digests.set_sums(digests.row_text(df.columns))
    df.observe(seen, *sums).write.format(format).save(f"{folder}/{name}")
    return name, format, df.schema.json(), int(seen.get["n"]), digests.digest_of_sums(seen.get)


def write_page(spark: SparkSession, folder: str, name: str, lines: DataFrame, order: list[str]) -> tuple[str, str, str, int, str]:
    """Write lines as one file in order and give its row of the manifest."""
    write_lines(spark, f"{folder}/{name}", redacted(lines), order)
    rows = spark.read.text(f"{folder}/{name}")
    told = digests.set_digest(rows, []).first()
    return name, "text", rows.schema.json(), told["rows"], told["digest"]


def publish(spark: SparkSession, target: str, parts: dict[str, DataFrame], check: Callable[[str], None] | None = None, format: str = "json", pages: dict[str, DataFrame] | None = None) -> None:
    """Write all parts to a staging folder, check them, and put the folder in the target's place.

    A part more, the manifest, states the number and an order-independent digest of each part's rows, taken
    while they are written. What is read back must have them and no secrets, after ``check`` too. ``pages``
    (part, section, position, line) become one text file each, in order.
    The former target comes back if the last step fails. Renames go through Hadoop's file system, so
    the target may be in any store that Spark writes to.
    """
    target, mark = target.rstrip("/"), uuid.uuid4().hex
    staging, backup = f"{target}.staging-{mark}", f"{target}.backup-{mark}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        stated = [write_part(staging, name, redacted(df), format) for name, df in parts.items()]
        stated += [write_page(spark, staging, name, lines, ["part", "section", "position"]) for name, lines in (pages or {}).items()]
        spark.createDataFrame(stated, "part string, format string, schema string, rows bigint, digest string").coalesce(1).write.json(f"{staging}/{MANIFEST}")
        if check:
            check(staging)
        if sorted(require_manifest(spark, staging)) != sorted([*parts, *(pages or {})]):
            raise NotWhole("the manifest names other parts")
        for name, form, schema, *_ in stated:
            require_no_secrets(spark.read.format(form).schema(StructType.fromJson(json.loads(schema))).load(f"{staging}/{name}"))
        there = fs.exists(path(target))
        if there and not fs.rename(path(target), path(backup)):
            raise OSError(f"cannot move {target} away")
        if not fs.rename(path(staging), path(target)):
            if there:
                fs.rename(path(backup), path(target))
            raise OSError(f"cannot publish {target}")
        fs.delete(path(backup), True)
    finally:
        fs.delete(path(staging), True)
