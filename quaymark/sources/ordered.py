"""Rows in a total order: numbered over all partitions, and written as one file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions.frames import cut

_ROW_BITS = 33


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by ranges of the order and sorted in each: partition after partition they are in order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows with their number from 1 in a total order, whose columns must tell any two rows apart.

    A partition's rows are numbered by themselves; what comes before it is a running sum over one row
    for each partition, so no task sees all rows.
    """
    placed = cut(in_order(rows, order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", F.col("_at"), F.lit(_ROW_BITS))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(before), part == F.col("_part")).withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def write_lines(spark: SparkSession, target: str, rows: DataFrame, order: list[str], line: str = "line") -> None:
    """One text file of the rows' lines in order, put in its place by one rename.

    Sorted parts are written by all tasks; their bytes are then strung together block by block, so neither a task nor
    the driver holds more than a block. A line with line ends is several lines. Nulls are left out.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, mark = jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    fs = path(target).getFileSystem(hadoop)
    parts, whole = path(f"{target}.parts-{mark}"), path(f"{target}.new-{mark}")
    try:
        in_order(rows.where(F.col(line).isNotNull()), order).select(F.col(line).alias("value")).write.text(parts.toString())
        out = fs.create(whole)
        try:
            for name in sorted(s.getPath().getName() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
                source = fs.open(path(parts, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                finally:
                    source.close()
        finally:
            out.close()
        if fs.exists(path(target)):
            fs.delete(path(target), False)
        if not fs.rename(whole, path(target)):
            raise OSError(f"cannot write {target}")
    finally:
        fs.delete(parts, True)
        fs.delete(whole, False)
