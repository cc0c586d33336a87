"""Cleaning a corpus for training, in five stages that each call one operator of ``weftwork.llm``.

toxicity: predicted toxic documents go; near duplicates: one document of each group stays; benchmark
decontamination: documents that hold a test item go; personal data: values become pseudonyms;
SentencePiece: each document becomes two sampled segmentations.

Null and empty texts are clean, alone and without personal data: they stay, and their segmentations are empty.
Rows that repeat a doc_id stay or go together. Columns beside doc_id and text are carried along, whatever their names;
n_chars is made anew. An empty table stays empty. The pseudonyms' key is the session's, spark.weftwork.pseudonymKey.
A stage's table is dropped where the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import decontamination, near_dedup, pseudonyms, segmentation, toxicity
from weftwork.llm.common import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs, shingle_words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.with_pseudonyms(docs, pseudonyms.session_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentation.sampled(docs, k=2, with_ids=True)


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", replace_personal_data), ("segmentation", encode)]

#: Hashing, edit distances, keyed permutations and lattice sampling are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    scratch, docs, before = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return docs
