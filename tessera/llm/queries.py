"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing
from tessera.llm.decontamination import benchmark_report
from tessera.llm.html_text import extract
from tessera.llm.ngram_join import ngram_join
from tessera.llm.oracles import ORACLES
from tessera.llm.private_data import private_report
from tessera.llm.quality_rules import quality_rules
from tessera.llm.shared import prepare, table
from tessera.llm.substring_dedup import substring_digest
from tessera.llm.token_output import token_output
from tessera.llm.toxicity import score_documents
from tessera.llm.warc_derivatives import warc_derivatives

#: The vocabulary file of operator 1's query.
VOCABULARY = "byte_bpe_50k.json"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join(table(spark, sf_dir, "documents"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return private_report(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mixture_report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return benchmark_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring_digest(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return extract(table(spark, sf_dir, "pages"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc_derivatives(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
