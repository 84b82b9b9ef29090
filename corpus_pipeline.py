"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, personal data, source mix.

Every stage takes an empty table (and gives one), null and empty texts, very long ones (read whole), repeated rows, null ids,
languages and sources, and extra columns of any name, which it carries; what each does with them stands with the operator it calls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandforge.llm import decontaminate, language, mixing, pii, simhash
from strandforge.llm.common import ensure_checkpoint_dir


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the others go, null texts and those without a letter among them."""
    return language.reject_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id.  Documents without an id stay unless their group has one with an id."""
    return simhash.keep_one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark table; those without an id are judged by text like any other."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by tags; every row stays, a null text too."""
    return pii.mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to equal shares of the sources, in shuffled order; a null source is a source.  Adds _copy and _order."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("mixing", mix),
]
#: A kernel classifier and an alignment are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result is written to the shared folder and read again as the next one's input.

    A stage's folder goes once the next one is written; the last one stays, as the result is read from it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = at
    return docs
