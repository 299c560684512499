"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symspark.llm import decontaminate, knn_quality, line_dedup, mixing, ngram_jaccard_join
from symspark.llm.store import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels not held out, doesn't reject; it rejects texts without words. Repeated rows are judged each."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = knn_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    return knn_quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated lines; n_chars follows the text (0 for a null one). Rows without a doc_id stay as they are."""
    done = line_dedup.drop_repeated_lines(docs)
    return done.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id; rows without an id and blank texts stay."""
    return ngram_jaccard_join.keep_one(docs, size=5, similarity="0.8")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts hold none."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their block, slot and position in the mixture of sources; a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: A nearest-neighbour classifier isn't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None
