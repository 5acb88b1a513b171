"""Documents to a training mix: quality rules, language ID, SimHash near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the
last return the columns of ``documents``; the last says how often each document is taken. Null ids and
repeated rows are judged by their texts, and empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontaminate, langid, mixing, rules, simhash
from quirework.llm.common import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where(F.col("copies") > 0).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing to target weights", mix)]

#: The models of the first two stages and XXH64 are beyond SQL. A test holds each stage's result in run()
#: against a plain restatement over what the stage before it left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written as Parquet in the shared folder and read again.

    The stages' folder, ``pipeline-<id>`` with a table a stage, stays for the result's reader; removing it is the caller's.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
