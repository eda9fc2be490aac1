"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bm25_pack import pack_documents
from tidemark.llm.entropy_mix import mix_documents
from tidemark.llm.line_chunks import dedup_lines, dedup_passages
from tidemark.llm.ngram_jaccard import one_of_each
from tidemark.llm.quality_rules import keep_quality
from tidemark.llm.queries import TOKENIZER
from tidemark.llm.scratch import Scratch
from tidemark.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that occur before; those with nothing left but white space go."""
    return dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, rows without one last.

    Rows are told apart by doc_id and text, so those without a doc_id stay unless they are near another row, and rows that
    repeat one are near duplicates only if their texts are.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, once the passages are gone that chunks of lines could not find."""
    docs = dedup_passages(docs)
    return mix_documents(docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path(TOKENIZER))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The last stage's tokens, and the search before it, are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
