"""Facts handed on over calls: callers get what the helpers that they reach contribute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.functions.frames import cut


def reachable(roots: DataFrame, calls: DataFrame, depth: int = 4) -> DataFrame:
    """(root, node, depth) over calls (caller, callee), each at its least depth, up to a depth limit.

    ``roots`` has one column, ``root``. Each step joins only what the step before found new, so cycles end;
    it is checkpointed, so a plan holds one step only.
    """
    calls = cut(calls)
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(calls, front.node == calls.caller).select("root", F.col("callee").alias("node")).distinct()
        front = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(front)
    return seen


def propagate(roots: DataFrame, calls: DataFrame, facts: DataFrame, depth: int = 4) -> DataFrame:
    """(root, fact) of all helpers within reach; ``facts`` has node and fact."""
    return reachable(roots, calls, depth).join(facts, "node").select("root", "fact").distinct()
