"""From raw documents to packed training sequences, in five stages over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm.common import Scratch
from tarnql.llm.exact_dedup import distinct_documents
from tarnql.llm.mixing import mixed_documents
from tarnql.llm.ngram_join import one_of_each
from tarnql.llm.packing import pack
from tarnql.llm.toxicity import clean_documents, trained_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among them, does not call toxic.

    Texts without words, null ones too, stay; repeated rows are judged alike; without labels of both kinds all stay.
    """
    return clean_documents(docs, trained_on(spark, sf_dir, docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id, a null one last; of rows that tie in both, one. Null texts count as empty."""
    return distinct_documents(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, linked by runs of five words at a similarity of 0.8.

    Texts without words, null ones too, and rows with a null doc_id stay.
    """
    return one_of_each(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the weights of their source ask; a null source is one of its own.

    Documents without words stand at the end.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, numbered in the order of the documents.

    That order is the rows' place in the files the stage before has written; a table that is not read from files has none, and
    sequences are then numbered by pattern. Null and empty texts are one token.
    """
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    if not docs.inputFiles():
        return pack(docs, tokenizer)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    place = F.struct(F.length(part).alias("digits"), part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return pack(docs.select("*", place.alias("_place")), tokenizer, order="_place")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the trained model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
