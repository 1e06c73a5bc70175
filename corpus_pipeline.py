"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)``: the Spark session, what the stage
before it kept, and the folder of the input tables. All but the last return the
columns of ``docs`` as they are. A stage's result is written as Parquet and read
again as the next one's input.

1. ``language_id`` drops documents without letters, and those whose language stays undetermined among the ones that its
   model knows; it can't tell a language that it never learned.
2. ``toxicity`` drops toxic documents.
3. ``near_dedup`` keeps one document of each class of near duplicates.
4. ``secret_scan`` masks secrets in the texts; it keeps every document.
5. ``packing`` packs the texts into sequences; one row per piece.

Null texts are rejected by the first stage, as they have no language; an empty
table passes through all stages as an empty one; further columns pass through
unchanged up to the fourth stage. What each operator does with ties, repeated
rows and clashing names is in its own docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import language_id as languages
from quire.llm import near_dedup as duplicates
from quire.llm import packing as packs
from quire.llm import secret_scan as secrets
from quire.llm import toxicity as toxic
from quire.llm.tables import delete, read, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return languages.accepted(docs, languages.train(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.accepted(docs, toxic.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return duplicates.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs, secrets.train(secrets.labelled_findings(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packs.pack(docs, with_ids=False)


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: Trained models and tokenizers can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's pieces.

    The tables between the stages stand in the cluster's shared folder, under
    a name of their own for each run. Each goes when the next one is written;
    the last one, which the result reads, can be removed once the result has
    been written.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
