"""The corpus pipeline: documents in, packed batches out.

Each stage is one operator; what a stage returns is written and read again, and the tables it made on the way are removed.
A null text counts as empty for every stage and stays null; rows without doc_id, or that repeat, are handled as each stage
says; an empty table gives an empty result; columns beside those of documents pass through all stages but the last,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import mixing, near, packing, quality, secrets
from issuelens.llm.common import passing, shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by all labels, doesn't reject; an empty text is judged like any other."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.good_documents(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id; rows that repeat a doc_id are one document, rows without doc_id all stay."""
    return near.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in text replaced by a mark; n_chars is that of the new text, and stays as it is where text is null."""
    return secrets.without_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each copy taken; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot for each row of the mix."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Fitted models and hashes decide the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
