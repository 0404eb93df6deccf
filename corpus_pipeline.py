"""A training-data pipeline over documents: stages that each apply one operator, written and read between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from llm.queries import VOCABULARY, learns_language, table
from llm.shared import plain, use_checkpoints

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter have no language and go."""
    return language_id.keep_known(docs.select(*map(plain, COLUMNS)), learns_language())


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.keep_first(docs.select(*map(plain, COLUMNS)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share word 5-grams by 0.8 or more, directly or through others, the one with the smallest id stays."""
    return jaccard_join.keep_one(docs.select(*map(plain, COLUMNS)))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs.select(*map(plain, COLUMNS)), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and of what they decode to."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("language id", known_language),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("bpe encoding", tokens),
]

#: Language identification learns its model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared checkpoint folder and read again."""
    use_checkpoints(spark)
    folder = spark.sparkContext.getCheckpointDir()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
