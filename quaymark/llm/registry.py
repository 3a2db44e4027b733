"""Queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm.common import read_table
from quaymark.llm.divergence import DIVERGENCE_SQL, divergence
from quaymark.llm.exact_dedup import DEDUP_SQL, dedup_digest
from quaymark.llm.gif import media_digest
from quaymark.llm.language_crf import language_digest
from quaymark.llm.packing import packing_digest
from quaymark.llm.quality_classifier import quality_digest
from quaymark.llm.quality_rules import rules_digest, rules_sql
from quaymark.llm.revisits import REVISITS_SQL, revisits_digest
from quaymark.llm.sampled_pieces import sampled_digest
from quaymark.llm.simhash import near_duplicates_digest
from quaymark.llm.suffix_dedup import repeats_digest
from quaymark.llm.toxicity import toxicity_digest
from quaymark.llm.variants import variants

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits_digest(read_table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(read_table(spark, sf_dir, "documents"))


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sampled_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(read_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_digest(read_table(spark, sf_dir, "documents"))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_digest(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(read_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_packing,
        op2_toxicity,
        op3_revisits,
        op4_language,
        op5_sampled_pieces,
        op6_suffix_dedup,
        op7_simhash,
        op8_gif,
        op9_quality_rules,
        op10_quality_classifier,
        op11_exact_dedup,
        op12_divergence,
        op13_variants,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_revisits": REVISITS_SQL, "op9_quality_rules": rules_sql(), "op11_exact_dedup": DEDUP_SQL, "op12_divergence": DIVERGENCE_SQL}
