"""Token counts through a digest cache.

Texts are identified by the SHA-256 of their content with runs of spaces, tabs and line ends written as one space,
which no pre-token or special token of the supported tokenizers spans. Counts are kept in a table by that digest
and a digest of the tokenizer's file and library. Only one text for each digest that the table lacks is encoded;
its count is appended, and all rows get their counts by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.tokens import encoder, tokenizer_version

CACHE_SCHEMA = "digest string, n_tokens long, version string"


def content_digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty, one that cannot be read raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(ids) for ids in encoder(path).encode(batch.column("text").cast(pa.binary()).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id long, text string).

    tokenizer: file of a BPE for the tokenizers library. cache: folder of the cache, by default a new one in the
    shared folder. n_bytes is the UTF-8 length; n_tokens counts ids without special tokens added, special strings
    in a text as the library reads them; over_limit is n_tokens > limit. A null text is like an empty one: 0 bytes,
    0 tokens. Equal texts are encoded once; rows without a doc_id are counted and keep none, repeated rows stay, other columns are ignored, an empty table gives no
    rows and appends none. A rerun finds all its digests stored and encodes nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    cache = cache or scratch.path("cache")
    version = tokenizer_version(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_at", F.coalesce("doc_id", F.xxhash64("text")))  # where a text is looked up; its digest is checked
    rows = scratch.keep(docs.select("doc_id", "_at", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest")))
    stored = read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens")
    misses = rows.groupBy("digest").agg(F.min("_at").alias("_at")).join(stored, "digest", "left_anti")
    misses = scratch.keep(misses)
    texts = docs.join(misses.hint("shuffle_hash"), "_at").select("digest", "text")
    counted = texts.where(content_digest(F.col("text")) == F.col("digest")).mapInArrow(lambda it: _count(it, tokenizer), "digest string, n_tokens long")
    scratch.write(counted.withColumn("version", F.lit(version)).write.mode("append"), cache)
    scratch.drop(misses)
    # Written before it is joined, so that the join can split the rows of a very common text.
    counts = scratch.keep(read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    out = rows.join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
