"""The corpus pipeline: stages over documents, each written and read again before the next.

Stages, in order: the quality classifier drops what it rejects; language identification drops what
it rejects (no letter, or no language with half of the words); of each group of near-duplicates (SimHash
trees over five-word shingles, completed to a similarity of at least 0.8) the document with the least id stays; byte strings
that repeat anywhere are cut out of the texts that are left; the texts are packed into pieces. All stages but the last return the columns of
``documents``; the texts that were cut have their lengths counted anew.

Defined cases: null texts count as empty, so the quality classifier decides on them and language
identification drops them; an empty table passes through; equal rows are one group of
near-duplicates; a group keeps one row, that of its least id (a null one is the last) and then of
the least hash of the row, so rows of different groups stay even where they share an id or have
none; other columns are left out.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import language_crf, near_copies, quality_classifier, suffix_dedup
from quaymark.llm.common import read_table
from quaymark.llm.packing import packing_digest

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language must have at least this share of a document's words.
LEAST_SHARE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.score_quality(docs, model, carry=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_crf.identify(docs, language_crf.train(docs), carry=COLUMNS[1:])
    return found.where((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows of one identity and id are taken for equal.
    identity = F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])
    found = near_copies.near_copies(docs, identity)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "identity")).alias("first"))
    rows = docs.select(*COLUMNS, identity.alias("identity")).join(kept.select("first.identity"), "identity", "left_semi")
    return rows.dropDuplicates(["identity", "doc_id"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(docs, carry=("lang", "source"), as_text=True).withColumnRenamed("kept", "text")
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing_digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("language identification", keep_language),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("repeated strings", cut_repeats),
    ("packing", pack),
]

#: Models and byte-level steps have no SQL; tests hold stages against brute force instead.
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own serves only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="pipeline-")).rstrip("/")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again.

    A stage's folder goes when the next one is written; the one that the last stage reads stays.
    """
    docs, folder, before = read_table(spark, sf_dir, "documents"), shared_folder(spark), None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            target = f"{folder}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(target)
            docs = spark.read.parquet(target)
            if before:
                path(before).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(before), True)
            before = target
    return docs
