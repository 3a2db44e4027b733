"""Points within spans: the smallest span that holds a point, and the innermost one of nested spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions.frames import cut, dealt

#: Spans of up to 16 ** k numbers have places of that size, up to this k.
MOST_DIGITS = 15


def smallest_enclosing(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """point_id and the name of the shortest span with ``start <= at <= end`` (ties: the least name), or null.

    Bounds are whole numbers. A span lies in one or two places of its own size, and a point asks one
    place of each size that occurs, so a key with many spans is joined by place, not as a whole; the
    bounds are the join's residual. Spans that end before they start hold nothing.
    """
    digits = F.least(F.length(F.hex(F.col(end) - F.col(start))), F.lit(MOST_DIGITS))
    place = lambda x, d: F.call_function("shiftright", x.cast("bigint"), (4 * d).cast("int"))
    held = spans.where(F.col(start) <= F.col(end)).select(*keys, start, end, name, digits.alias("_digits"))
    sizes = held.agg(F.collect_set("_digits").alias("s")).scalar()
    held = held.withColumn("_place", F.explode(F.sequence(place(F.col(start), F.col("_digits")), place(F.col(end), F.col("_digits")))))
    asked = points.select(*keys, point_id, F.col(at).alias("_at")).withColumn("_digits", F.explode(sizes)).withColumn("_place", place(F.col("_at"), F.col("_digits")))
    found = asked.join(held, [*keys, "_digits", "_place"]).where(F.col("_at").between(F.col(start), F.col(end)))
    best = found.groupBy(point_id).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("w"), F.col(name).alias("v"))).alias("best"))
    return points.select(point_id).join(best, point_id, "left").select(point_id, F.col("best.v").alias(name))


#: Numbers in a block of the sweep.
BLOCK = 1 << 16
#: Starts, ends and points that one task sorts.
SWEPT = 500_000


def innermost_scope(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, at: str, start: str, end: str, name: str, block: int = BLOCK) -> DataFrame:
    """point_id and the name of the innermost span ``[start, end)`` around each point, or null, by one sweep over the sorted ends of all spans.

    The spans of a key nest: two of them are apart, touch, or one holds the other; of spans with equal bounds the
    last by name is the inner one. A point at which one span ends and another starts is in the second. Spans
    that do not end after they start hold nothing. Ids of points are unique.

    Starts, ends and points are sorted together in blocks of ``block`` numbers. How many spans are open is a running
    sum; the innermost span at a depth is the last one that started there, in the block or before it. What a block
    hands to later ones is a row for each depth, so a key's rows are never sorted in one task, and the work is linear but for sorting.
    Only a span that ends in a later block is handed on. What each block adds is counted first; the number of tasks follows from it.
    """
    place = lambda x: F.floor(F.col(x) / F.lit(block)).cast("bigint").alias("_block")
    none = lambda kind, alias: F.lit(None).cast(kind).alias(alias)
    named = spans.schema[name].dataType
    held = spans.where(F.col(start) < F.col(end))
    # At one place spans end first, then start, the longest first, then come points.
    rows = held.select(*keys, place(end), F.col(end).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), none("bigint", "_size"), F.lit(-1).alias("_step"), none(named, "_name"), none(points.schema[point_id].dataType, "_id"))
    rows = rows.unionByName(held.select(*keys, place(start), F.col(start).cast("bigint").alias("_at"), F.lit(1).alias("_kind"), (F.col(start) - F.col(end)).cast("bigint").alias("_size"), F.lit(1).alias("_step"), F.col(name).alias("_name"), none(points.schema[point_id].dataType, "_id"), (place(end) > place(start)).alias("_on")), allowMissingColumns=True)
    rows = rows.unionByName(points.select(*keys, place(at), F.col(at).cast("bigint").alias("_at"), F.lit(2).alias("_kind"), none("bigint", "_size"), F.lit(0).alias("_step"), none(named, "_name"), F.col(point_id).alias("_id")), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut(rows.groupBy(*keys, "_block").agg(F.sum("_step").alias("_net"), F.count(F.lit(1)).alias("_n")))
    # A block begins with what is open before it.
    opened = counted.select(*keys, "_block", F.lit(None).cast("bigint").alias("_at"), F.lit(-1).alias("_kind"), none("bigint", "_size"), F.coalesce(F.sum("_net").over(before), F.lit(0)).alias("_step"), none(named, "_name"), none(points.schema[point_id].dataType, "_id"))
    order = ["_at", "_kind", "_size", "_name"]
    so_far = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = dealt(rows.withColumn("_step", F.col("_step").cast("bigint")).unionByName(opened, allowMissingColumns=True), counted.agg(F.sum("_n")).first()[0], SWEPT, *keys, "_block")
    swept = blocks.withColumn("_depth", F.sum("_step").over(so_far)).where("_kind > 0")
    inside = Window.partitionBy(*keys, "_block", "_depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("_in", F.last("_name", ignorenulls=True).over(inside))
    # What is still open from an earlier block: the last start at that depth, a row for each block and depth.
    handed = swept.where("_kind = 1 AND _on").groupBy(*keys, "_block", "_depth").agg(F.max_by("_name", F.struct("_at", "_size", "_name")).alias("_last"))
    asked = swept.where("_kind = 2 AND _in IS NULL AND _depth > 0").select(*keys, "_block", "_depth").distinct()
    both = handed.unionByName(asked.withColumn("_last", none(named, "_last")))
    earlier = Window.partitionBy(*keys, "_depth").orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    carried = both.select(*keys, "_block", "_depth", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where("_carried IS NOT NULL").distinct()
    found = swept.where("_kind = 2").join(carried, [*keys, "_block", "_depth"], "left")
    return found.select(F.col("_id").alias(point_id), F.when(F.col("_depth") > 0, F.coalesce("_in", "_carried")).alias(name))
