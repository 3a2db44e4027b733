"""Duplicates: merged, refused, or reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateIdentity(ValueError):
    """Two rows claim the same identity."""


def duplicate_identities(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> None:
    """Raise before anything is written when an identity comes twice."""
    found = duplicate_identities(rows, keys).limit(1).collect()
    if found:
        raise DuplicateIdentity(f"duplicate identity: {found[0].asDict()}")


def merge_evidence(rows: DataFrame, keys: list[str], order: str, evidence: str, confidence: str) -> DataFrame:
    """One row for each identity: distinct evidence in order of first sight, confidence raised to confirmed by any row."""
    first = rows.groupBy(*keys, evidence).agg(F.min(order).alias("_at"), F.max(F.col(confidence) == "confirmed").alias("_sure"), F.min_by(confidence, order).alias("_first"))
    merged = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(evidence).alias("_e")))).alias("_list"), F.max("_sure").alias("_sure"), F.min_by("_first", "_at").alias("_first"))
    return merged.select(*keys, F.transform("_list", lambda x: x["_e"]).alias(evidence), F.when(F.col("_sure"), "confirmed").otherwise(F.col("_first")).alias(confidence))


def first_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key: the limit is what is asked for (evidence lists)."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in others])


def snapshots(rows: DataFrame, content: str, keep: str) -> DataFrame:
    """One row for each distinct content, with its SHA-256, the least ``keep`` and how many there were."""
    return rows.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(keep).alias(keep), F.count("*").alias("copies"))


def snapshot_conflicts(rows: DataFrame, repository: str, commit: str, content_hash: str) -> DataFrame:
    """Repositories given at differing commits, or with differing contents at one commit."""
    counted = rows.groupBy(repository).agg(F.count_distinct(commit).alias("commits"), F.count_distinct(content_hash).alias("contents"))
    return counted.where("commits > 1 OR contents > 1").withColumn("conflict", F.when(F.col("commits") > 1, "different_commits").otherwise("different_contents"))


def distinct_unresolved(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Issues once each by all their keys, null like any value."""
    return rows.select(*keys).distinct()


#: Issue categories by what the code says, in order.
CATEGORIES = (("soap", "integration"), ("integration", "integration"), ("semantic", "semantics"), ("contract", "contract"), ("request", "contract"), ("response", "contract"), ("route", "endpoint"), ("url", "endpoint"))


def issue_category(code: Column, default: str = "other") -> Column:
    found = None
    for needle, category in CATEGORIES:
        test = F.lower(code).contains(needle)
        found = F.when(test, category) if found is None else found.when(test, category)
    return found.otherwise(default)
