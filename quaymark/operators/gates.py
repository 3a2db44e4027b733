"""Completion gates: the strongest status that facts allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completion(outputs_valid: Column, inventory_complete: Column, required: Column, supported: Column, unsupported_surfaces: Column) -> Column:
    """``failed`` without valid outputs, ``partial`` with anything open, else ``complete``; unknown counts as open."""
    covered = F.size(F.array_except(F.coalesce(required, F.array().cast("array<string>")), F.coalesce(supported, F.array().cast("array<string>")))) == 0
    done = F.coalesce(inventory_complete, F.lit(False)) & covered & (F.coalesce(unsupported_surfaces, F.lit(1)) == 0)
    return F.when(~F.coalesce(outputs_valid, F.lit(False)), "failed").when(done, "complete").otherwise("partial")


def group_completion(rows: DataFrame, keys: list[str], supported: Column, pending: Column) -> DataFrame:
    """Each group's status from its rows: all supported and nothing pending is complete."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(pending).alias("pending"), F.bool_and(supported).alias("all_supported")).withColumn(
        "status", F.when(F.col("all_supported") & (F.col("pending") == 0), "complete").otherwise("partial")
    )


def contract_scope(exposed: Column, pending: Column, unresolved: Column) -> Column:
    """How far the contracts of exposed endpoints were evaluated, by their numbers: all, those pending and open facts."""
    return F.when(exposed == 0, "not_applicable").when(unresolved > 0, "evaluated_partial").when(pending == 0, "evaluated_complete").otherwise("required_not_complete")


def correlation_scope(consumed: Column, required: Column) -> Column:
    """Whether a match with providers was asked for and could be made by one audit alone."""
    return F.when(~required, "out_of_scope").when(consumed == 0, "not_applicable").otherwise("required_not_evaluable")


def audit_gate(inventory_complete: Column, discovery_complete: Column, surfaces: Column, unsupported: Column, unresolved: Column, contracts: Column, correlation: Column) -> Column:
    """``complete`` if nothing is open: inventory, discovery, surfaces without a detector, unsupported detectors, unresolved facts and both scopes."""
    shut = (
        F.coalesce(inventory_complete & discovery_complete, F.lit(False))
        & (F.coalesce(surfaces + unsupported + unresolved, F.lit(1)) == 0)
        & ~contracts.isin("required_not_complete")
        & ~correlation.isin("required_not_evaluable")
    )
    return F.when(shut, "complete").otherwise("partial")
