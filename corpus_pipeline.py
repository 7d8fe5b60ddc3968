"""The training-data pipeline: five filters and transforms of `documents`, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import packing, secrets, simhash, suffix_dedup, toxicity
from clausewright.llm.common import shared_folder, table
from clausewright.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE = 5  # words
ALIKE, BANDS = 0.8, 8  # Jaccard similarity of the shingle sets, among texts that share one of eight keys of least hashes


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs.select(*COLUMNS), net)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return simhash.keep_one(docs.select(*COLUMNS), SHINGLE, alike=ALIKE, bands=BANDS)


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that repeat."""
    return _with_text(suffix_dedup.without_repeats(docs.select(*COLUMNS), width=suffix_dedup.PASSAGE, unit=suffix_dedup.WORDS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return _with_text(secrets.mask(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("suffix array", suffix_array_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]
#: The stages are trained or iterative; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_folder(spark)}/pipeline_{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs
