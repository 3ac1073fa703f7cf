"""From raw documents to token ids: quality rules, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
returns token ids. Null columns, empty texts and repeated rows get the results that the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import _blocks, decontaminate, jaccard_join, line_dedup, quality_rules, sentence_pieces
from terraframe.llm._session import table


def _measured(docs: DataFrame, before: DataFrame) -> DataFrame:
    """docs with n_chars of the new texts, and the columns as before."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return docs.select(*before.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram likelihood ratio."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first only; documents left without words go."""
    return _measured(line_dedup.drop_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on shingles of five words."""
    return jaccard_join.near_dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that mostly consist of them go."""
    return _measured(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the hash of the text that the ids decode to."""
    return sentence_pieces.encode(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_near_duplicates", near_duplicates),
    ("decontaminate", benchmark_passages),
    ("sentence_pieces", tokens),
]

#: SQL can't express the likelihood ratio's hash and the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each but the last is written as Parquet in the shared folder and read again."""
    _blocks.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
