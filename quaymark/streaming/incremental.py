"""New sources as they arrive: files stream in and their endpoints are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaymark.operators.extraction import extract
from quaymark.sources.files import MAX_BYTES, unread

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_tree(spark: SparkSession, root: str, repository_id: str, max_files: int = 1000) -> DataFrame:
    """repository_id, path, length and text of arriving files; text is null where it is too long or not UTF-8."""
    rows = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    text = F.when((F.col("length") <= MAX_BYTES) & F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return rows.select(F.lit(repository_id).alias("repository_id"), "path", "length", text.alias("text"))


def stream_unread(spark: SparkSession, root: str, repository_id: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Issue rows of arriving candidate files whose text was not read, appended to ``target``."""
    writer = unread(stream_tree(spark, root, repository_id)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_endpoints(spark: SparkSession, root: str, repository_id: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows of each new file, appended to ``target``; a restart goes on where the checkpoint ends."""
    writer = extract(stream_tree(spark, root, repository_id)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
