"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.frames import cut


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through checkpoint() in the shared folder the cluster names."""
    return cut(df)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle width, which grows with the cluster and the data it was set for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int, of_text: Column | None = None) -> DataFrame:
    """doc_id, label and text of at most ``most`` ids, by a hash of doc_id: the same ones at each run.

    An id has one row however often it is repeated: of several labels (``labels``: doc_id, label) the
    least, and of several texts that of the least hash. ``of_text`` is the label of a text itself; then
    the text is one of those with the id's label. Null ids are left out. The sample is broadcast, as its
    number of rows is bounded; what is joined to it is brought to one row an id before it is used.
    """
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label").where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = [] if of_text is None else [of_text.alias("label")]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *own, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    joined = texts.join(F.broadcast(chosen), ["doc_id", "label"] if own else ["doc_id"])
    return joined.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("doc_id", "label", "first.text")


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of one column, one row at least: what is made of texts at once is bounded by bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def bare_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text as UTF-8 bytes, empty where null."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def map_texts(docs: DataFrame, outputs: str, compute: Callable[[list[bytes]], list[pa.Array]], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, and the outputs (``name type, ...``) that ``compute`` gives a list of whole texts.

    A null text is an empty one to ``compute`` and stays null where it is carried. Carried columns
    must not have the names of outputs.
    """
    others = [c for c in carry if c != "text"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(others)])
    place = {c: 2 + k for k, c in enumerate(others)} | {"text": 1}
    kinds = [f.dataType.simpleString() for f in rows.schema]
    names = [f"carried_{k}" for k in range(len(carry))]
    schema = ", ".join(["doc_id bigint", *(f"{n} {kinds[place[c]]}" for n, c in zip(names, carry, strict=True)), outputs])
    found = [x.split()[0] for x in outputs.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                carried = [batch.column(place[c]) for c in carry]
                yield pa.RecordBatch.from_arrays([batch.column(0), *carried, *compute(texts)], names=["doc_id", *names, *found])

    return rows.mapInArrow(scan, schema).toDF("doc_id", *carry, *found)
