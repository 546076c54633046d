"""A corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, and others that docs has, whatever their names. Null, empty and very long texts, ties, repeated
rows and empty tables are handled as each operator's own module says; an empty table passes every stage as one.
"""
from __future__ import annotations

import os
import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, jaccard_join, mixing, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are predicted toxic, by a model learnt from labels; without labels of both kinds all stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The near-copy stage's own measure; op6's contract (4 and 85) is another.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
#: Pieces that a task of the last stage keeps: by then the stages before it have filled the executors' memory.
REMEMBERED = 100_000


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the smallest doc_id, null last. Documents without a word all stay."""
    return jaccard_join.one_of_each(docs, NEAR_SHINGLE, NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the words of 20-word windows that start earlier too; every row stays, if with an empty text."""
    return substring_dedup.dedup_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each epoch that takes it, cut where its source's target ends. Rows without a word go."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and digests of each row's ids and of the decoded text; a null text is an empty one."""
    return bpe.digest(docs, public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.tiktoken"), REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode),
]

#: The first stage's model cannot be expressed in SQL.
ORACLE_SQL = None


def _local_folder(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is to name a folder that all machines share")
    return "file://" + tempfile.mkdtemp(prefix="corpus-pipeline-", dir=os.environ.get("TMPDIR"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; tables between them are in the shared folder of spark.checkpoint.dir."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{at}/pipeline-{uuid.uuid4().hex}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
