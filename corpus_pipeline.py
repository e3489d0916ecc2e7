"""From raw documents to training sequences: four stages that each take what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.ordering import shared_folder
from plumbline.llm import mil_toxicity, ngram_join, packing, substring_dedup


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the model trained on ``labels`` calls toxic."""
    return mil_toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each class linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, share=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that an earlier document holds; what is left is the text, empty texts go.

    ``n_chars`` is that of the new text.
    """
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    # all other columns travel packed, whatever they are called
    rest = F.struct(*([F.col(f"`{c}`") for c in docs.columns if c not in own] or [F.lit(True)]))
    cut = substring_dedup.parse(docs.select("doc_id", "text", rest.alias("rest")), window=50)
    left = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    return left.select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its place and ids."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("sequences", sequences)]

ORACLE_SQL = None  # a trained model and a packing decide the rows; tests compare the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are kept in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{name}")
    return docs
