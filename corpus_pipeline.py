"""A training corpus from ``documents``: rules, near copies, contamination, mixture, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every
stage but the last returns the columns of ``documents``.  ``run`` applies them in order,
each written as Parquet in the shared folder and read again as the next one's input.

Null and empty texts fail the first stage's base rule.  An empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontamination import decontaminate
from tessera.llm.mixing import sample_mixture
from tessera.llm.ngram_join import drop_near_copies
from tessera.llm.quality_rules import apply_rules, learned_rules
from tessera.llm.shared import made, prepare, release, shared_path, sweep, table, written
from tessera.llm.token_output import token_output

VOCABULARY = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps."""
    prepare(spark)
    rules = learned_rules(docs, table(spark, sf_dir, "labels"))
    packed = docs.select("text", F.struct("*").alias("_own"))  # statistics may be named like columns of docs
    return apply_rules(packed, rules).where("kept").select("_own.*")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    prepare(spark)
    return drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    prepare(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the production mixture."""
    prepare(spark)
    return sample_mixture(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and the digest of each document read back from them."""
    import public_tokenizers

    prepare(spark)
    return token_output(docs, public_tokenizers.path(VOCABULARY), folder=shared_path(spark, "corpus-tokens"))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_join", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The learned list, the verified groups and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, since, docs)  # the stage before and what this one made on the way
        release(spark)
    return docs
