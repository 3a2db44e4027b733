"""Frames whose lineage is cut, for steps that build on one another, and the number of tasks that rows are dealt to."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, held by checkpoint() in the folder that ``spark.checkpoint.dir`` names.

    A folder of our own serves only where none is named and the master is local.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def tasks(amount: int | None, of_one: int) -> int:
    """How many tasks share an amount, so that one has about ``of_one`` of it.

    Rows that a shuffle compresses well, or that grow in the task that reads them, are dealt to a stated number of tasks:
    the engine's own choice goes by compressed bytes and by a setting that does not grow with the input.
    """
    return max(1, -(-(amount or 0) // of_one))


def dealt(df: DataFrame, amount: int | None, of_one: int, *by: str | Column) -> DataFrame:
    """The rows dealt to ``tasks(amount, of_one)`` tasks by some columns, or evenly."""
    return df.repartition(tasks(amount, of_one), *by)
