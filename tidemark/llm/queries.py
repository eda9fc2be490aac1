"""The queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import block_max, bm25_pack, entropy_mix, line_chunks, ngram_jaccard, periodic_runs, pivot_index, quality_rules, secret_scan, token_count, toxic_passages, url_filter, warc
from tidemark.llm.oracle import ORACLE
from tidemark.llm.tokens import tokenizer_path

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=5, percent=80)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_filter.label_outcomes(_table(spark, sf_dir, "labels"))
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), outcomes)


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_table(spark, sf_dir, "documents"))


def op8_bm25_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_pack.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix_copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.chunk_report(_table(spark, sf_dir, "documents"), kinds=(line_chunks.CHUNKS, line_chunks.PASSAGES))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.search(block_max.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_passages.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(periodic_runs.with_periods(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard, op2_secret_scan, op3_url_filter, op4_token_count, op5_embedding_dedup, op6_warc, op7_quality_rules, op8_bm25_pack, op9_entropy_mix, op10_line_chunks, op11_ranked_search, op12_toxic_passages, op13_periodic_runs)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """For the others: the encoded texts, the index, the Newton steps and the hashes are beyond SQL; see the tests."""
    return dict(ORACLE)
