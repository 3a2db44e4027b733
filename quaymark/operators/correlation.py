"""Consumers joined with providers, and what the join's cardinality says.

Providers are counted for each key before the join, so no key's providers are ever gathered in one
row or task, and each consumer comes out exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("matched_confirmed", "unique_candidate", "ambiguous", "unmatched")


def candidate_status(n_candidates: Column, n_proven: Column) -> Column:
    """Exactly one proven provider confirms a match; otherwise the number of candidates decides."""
    return (
        F.when(n_candidates == 0, "unmatched")
        .when(n_proven == 1, "matched_confirmed")
        .when(n_candidates == 1, "unique_candidate")
        .otherwise("ambiguous")
    )


def correlate(consumers: DataFrame, providers: DataFrame, keys: list[str], consumer_id: str, provider_id: str, stated: str | None = None, identities: list[str] | None = None) -> DataFrame:
    """consumer_id, keys, candidate_count, proven_count, provider (if there is just one) and status.

    ``stated`` names the consumers' column with an explicit provider identity, and ``identities`` the
    providers' columns that it may equal. Null keys match nothing.
    """
    counted = providers.groupBy(*keys).agg(F.count("*").alias("candidate_count"), F.min(provider_id).alias("least_provider"))
    joined = consumers.join(counted, keys, "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    if stated and identities:
        names = providers.select(*keys, F.col(provider_id).alias("proven_by"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(c).cast("string") for c in identities])))).alias("identity"))
        # One row for each key and identity, so the join below cannot multiply consumers.
        proof = names.groupBy(*keys, "identity").agg(F.count("*").alias("proven_count"), F.min("proven_by").alias("proven_provider"))
        joined = joined.withColumn("identity", F.col(stated).cast("string")).join(proof, [*keys, "identity"], "left")
    else:
        joined = joined.withColumn("proven_count", F.lit(None).cast("bigint")).withColumn("proven_provider", F.lit(None).cast(providers.schema[provider_id].dataType))
    joined = joined.withColumn("proven_count", F.coalesce("proven_count", F.lit(0)))
    status = candidate_status(F.col("candidate_count"), F.col("proven_count"))
    provider = F.when(status == "matched_confirmed", F.col("proven_provider")).when(status == "unique_candidate", F.col("least_provider"))
    return joined.select(consumer_id, *keys, F.col("candidate_count").cast("bigint").alias("candidate_count"), F.col("proven_count").cast("bigint").alias("proven_count"), provider.alias("provider"), status.alias("status"))


def candidates(consumers: DataFrame, providers: DataFrame, keys: list[str], consumer_id: str, provider_id: str) -> DataFrame:
    """The edges themselves, for who wants to list them."""
    return consumers.select(consumer_id, *keys).join(providers.select(provider_id, *keys), keys)


def coverage(correlated: DataFrame, n_providers: DataFrame | None = None) -> DataFrame:
    """One row: consumers, each status, distinct providers named, and whether the counts reconcile."""
    counts = {s: F.count_if(F.col("status") == s).cast("bigint") for s in STATUSES}
    return correlated.agg(
        F.count("*").alias("consumers"), *[c.alias(s) for s, c in counts.items()], F.count_distinct("provider").alias("providers_named"), (F.count("*") == sum(counts.values())).alias("reconciled")
    )


def reverse_index(correlated: DataFrame, providers: DataFrame, keys: list[str], consumer_id: str, provider_id: str) -> DataFrame:
    """(provider_id, status, consumer_id): the consumers that come to one provider, a row each.

    An ambiguous consumer belongs to all providers of its key alike; such edges are not multiplied out
    but counted by ``ambiguous_of``, and stand as two sides of one key in ``correlated`` and ``providers``.
    """
    named = correlated.where(F.col("provider").isNotNull()).select(F.col("provider").alias(provider_id), "status", consumer_id)
    return named.join(providers.select(provider_id).distinct(), provider_id, "left_semi")


def ambiguous_of(correlated: DataFrame, providers: DataFrame, keys: list[str], provider_id: str) -> DataFrame:
    """(provider_id, ambiguous): the number of ambiguous consumers of each provider's key, counted by key."""
    counted = correlated.where("status = 'ambiguous'").groupBy(*keys).agg(F.count("*").alias("ambiguous"))
    return providers.select(provider_id, *keys).join(counted, keys, "left").select(provider_id, F.coalesce("ambiguous", F.lit(0)).cast("bigint").alias("ambiguous"))
