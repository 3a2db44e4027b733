"""Digests of sets of rows that do not depend on their order or partitions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES, DIGITS = 4, 15


def row_text(columns: list[str]) -> Column:
    """A row as JSON, with its columns by name and its nulls; equal rows have equal texts."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def lane(digest: Column, k: int) -> Column:
    """Fifteen hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1 + DIGITS * k, DIGITS), 16, 10).cast("decimal(38,0)")


def set_sums(row: Column) -> list[Column]:
    """Aggregates of a multiset of texts: their number and the sums of the lanes of their SHA-256."""
    digest = F.sha2(row, 256)
    return [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(lane(digest, k)), F.lit(0).cast("decimal(38,0)")).alias(f"lane{k}") for k in range(LANES)]]


def set_digest(rows: DataFrame, keys: list[str], row: Column | None = None) -> DataFrame:
    """keys, rows and digest of each group of rows: equal for equal multisets, in whatever order and partitions.

    Partial sums are made before the shuffle, so a group of any size is a row for each task.
    """
    told = rows.groupBy(*keys).agg(*set_sums(row_text([c for c in rows.columns if c not in keys]) if row is None else row))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", *[f"lane{k}" for k in range(LANES)])])
    return told.select(*keys, F.col("n").alias("rows"), F.sha2(text, 256).alias("digest"))


def digest_of_sums(sums: dict) -> str:
    """The digest of sums that were taken otherwise, as by ``DataFrame.observe``."""
    return hashlib.sha256(":".join(str(int(sums[c])) for c in ("n", *[f"lane{k}" for k in range(LANES)])).encode()).hexdigest()
