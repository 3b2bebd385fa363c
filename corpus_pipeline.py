"""The corpus pipeline: quality rules, quality classifier, near duplicates, decontamination, SentencePiece ids.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame. ``run`` writes each stage's rows as Parquet to the
folder of ``spark.checkpoint.dir`` and reads them again for the next one, so that a lost executor costs at most the stage in hand;
a stage's folder is removed once the next one's rows are written.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import decontaminate, ngram_join, piece_codec, quality_knn, quality_rules
from chronoloom.llm.common import read_table, with_checkpoint_dir


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps."""
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled documents of the folder, predicts to be good."""
    model = quality_knn.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality_knn.keep_good(docs, model)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return ngram_join.keep_one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item stands in."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their SentencePiece ids."""
    return piece_codec.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality_rules", rule_stage),
    ("quality_classifier", classifier_stage),
    ("ngram_jaccard", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("sentencepiece", piece_stage),
]

#: The classifier and the piece codec can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    folder = f"{with_checkpoint_dir(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, f"{folder}/{done}")
        done = name
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
