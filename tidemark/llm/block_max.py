"""Ranked lexical search with block-max pruning.

Documents are indexed in blocks of neighbouring rows. A block has a forward index (for each document its length and the
terms it holds, as numbers within the block, with their occurrences) and a head (its terms, the number of its documents
with each, and each term's greatest impact). The impact is the part of a score that does not depend on the query, so the sum of weight times
greatest impact over a query's terms bounds the score of every document of the block, in whole numbers. A search reads
the heads, scores each query's most promising block, and takes the score of the k-th best document there as threshold.
Then every task sorts its blocks by a query's bound and scores their forward indexes until the bound drops below the
threshold, which rises with what the task finds. Each task gives k documents a query at most; the best k of all remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.terms import term_counts, term_lists

#: A block ends after so many documents or so many terms, repeats included.
BLOCK_DOCS, BLOCK_TERMS = 64, 1 << 16
#: Queries are searched together until they have so many terms; the driver holds one such round at a time.
ROUND_TERMS = 1 << 18
#: Bytes of blocks that a task holds at a time; it reads so many blocks from a file, and gives Python so many, at once.
HELD_BYTES, READ_BLOCKS = 8 << 20, 16
# Documents a query; a score's unit, the part of a document's length in it in percent, and its factors.
MOST = 10
UNIT, LENGTH_PERCENT, TF_FACTOR, LENGTH_FACTOR = 1_000_000_000, 90, 1000, 8

_INDEX = "doc_ids array<long>, sizes binary, ends binary, local binary, tf binary, terms binary, dfs binary, maxima binary"
_FOUND = "query int, item_id long, score long, doc_id long"


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term with tf occurrences adds to a document of n terms for each unit of weight."""
    length = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * docs) // terms
    return (UNIT * tf) // (TF_FACTOR * tf + LENGTH_FACTOR * length)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _narrow(x: np.ndarray) -> bytes:
    """x in the narrowest of three types, which _wide tells apart by the number of values."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return _stored(raw, n).astype(np.int64)


def _stored(raw: bytes, n: int) -> np.ndarray:
    """The values as they are stored, in the type they have there."""
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for n in term_counts(batch.column("text").cast(pa.binary()).to_pylist()):
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents with terms, in the order of the rows."""
    ids: list[int | None] = []
    lists: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        sizes = np.array([len(x) for x in lists], np.int64)
        terms, local = np.unique(np.concatenate(lists), return_inverse=True)
        places, tf = np.unique(np.repeat(np.arange(len(lists)), sizes) * len(terms) + local, return_counts=True)
        doc, local = np.divmod(places, len(terms))
        maxima = np.zeros(len(terms), np.int64)
        np.maximum.at(maxima, local, impacts(tf, sizes[doc], n_docs, n_terms))
        ends = np.cumsum(np.bincount(doc, minlength=len(lists)))
        raw = [sizes.tobytes(), ends.tobytes(), _narrow(local), _narrow(tf), terms.tobytes(), _narrow(np.bincount(local)), _narrow(maxima)]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in raw)], [c.split()[0] for c in _INDEX.split(", ")])

    held = 0
    for batch in batches:
        for doc_id, terms in zip(batch.column("doc_id").to_pylist(), term_lists(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
            if len(terms):
                ids.append(doc_id)
                lists.append(terms)
                held += len(terms)
            if len(ids) == BLOCK_DOCS or held >= BLOCK_TERMS:
                yield block()
                ids, lists, held = [], [], 0
    if ids:
        yield block()


@dataclass(frozen=True)
class Index:
    """Blocks with heads and forward indexes; docs and terms: the documents with a term, and all their terms."""

    blocks: DataFrame
    docs: int
    terms: int


def build_index(docs: DataFrame, scratch: Scratch | None = None) -> Index:
    """The index of docs (doc_id long, text string). Texts that are null or have no term are not in it and not counted.

    Terms are told apart by 64-bit hashes. Rows without a doc_id and rows that repeat one are documents of their own.
    """
    scratch = scratch or Scratch(docs.sparkSession, "search")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, terms = rows.select("text").mapInArrow(_count_terms, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n, terms = n or 0, terms or 0
    blocks = rows.mapInArrow(lambda it: _blocks(it, n, terms), _INDEX).withColumn("block_id", F.monotonically_increasing_id())
    # Rows are large, so few of them are read at a time.
    return Index(scratch.keep(blocks, settings={"spark.sql.parquet.columnarReaderBatchSize": str(READ_BLOCKS), "spark.sql.execution.arrow.maxRecordsPerBatch": str(READ_BLOCKS)}), n, terms)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [np.unique(t).tobytes() for t in term_lists(batch.column("text").cast(pa.binary()).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.binary())], ["item_id", "terms"])


class _Round:
    """Some queries: their terms as places in one sorted vocabulary, and later the weights of these."""

    def __init__(self, rows: list[Row]):
        self.items = [r["item_id"] for r in rows]
        own = [np.frombuffer(r["terms"], np.uint64) for r in rows]
        self.vocabulary = np.unique(np.concatenate(own))
        self.at = [np.searchsorted(self.vocabulary, x) for x in own]
        self.starts = np.cumsum([0, *(len(x) for x in own)])
        self.flat = np.concatenate(self.at)
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.least = np.ones(len(rows), np.int64)  # a score that counts

    def places(self, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each term of the vocabulary whether a block's head has it, and where."""
        own = np.frombuffer(terms, np.uint64)
        at = np.minimum(np.searchsorted(own, self.vocabulary), len(own) - 1)
        return own[at] == self.vocabulary, at

    def bounds(self, terms: bytes, maxima: bytes) -> np.ndarray:
        """The most that a document of the block can score, for each query."""
        has, at = self.places(terms)
        most = np.where(has, _wide(maxima, len(terms) // 8)[at], 0) * self.weights
        return np.add.reduceat(most[self.flat], self.starts[:-1])


def _frequencies(batches: Iterator[pa.RecordBatch], queries: _Round) -> Iterator[pa.RecordBatch]:
    df = np.zeros(len(queries.vocabulary), np.int64)
    for batch in batches:
        for terms, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist(), strict=True):
            has, at = queries.places(terms)
            df += np.where(has, _wide(dfs, len(terms) // 8)[at], 0)
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])], ["term", "df"])


def _best_blocks(batches: Iterator[pa.RecordBatch], queries: _Round) -> Iterator[pa.RecordBatch]:
    """Each query's block with the greatest bound in this task."""
    best, where = np.zeros(len(queries.items), np.int64), np.zeros(len(queries.items), np.int64)
    for batch in batches:
        for block, terms, maxima in zip(*(batch.column(c).to_pylist() for c in ("block_id", "terms", "maxima")), strict=True):
            bound = queries.bounds(terms, maxima)
            where[bound > best] = block
            best = np.maximum(best, bound)
    seen = np.flatnonzero(best)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(best[seen]), pa.array(where[seen])], ["query", "bound", "block_id"])


class _Best:
    """The k best documents of each query so far, by score, then doc_id with null last."""

    def __init__(self, queries: _Round, k: int):
        self.k = k
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(queries.items)
        self.least = queries.least.copy()

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        good = scores >= self.least[q]
        if not good.any():
            return
        scores, ids, no_id = (np.concatenate(x) for x in zip(self.found[q], (scores[good], ids[good], no_id[good]), strict=True))
        order = np.lexsort((ids, no_id, -scores))[: self.k]
        self.found[q] = scores[order], ids[order], no_id[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], scores[order[-1]])

    def rows(self, items: list[int | None]) -> pa.RecordBatch:
        n = [len(x[0]) for x in self.found]
        scores, ids, no_id = (np.concatenate([x[i] for x in self.found]) for i in range(3))
        query = np.repeat(np.arange(len(n)), n)
        return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array([items[q] for q in query], pa.int64()), pa.array(scores), pa.array(ids, mask=no_id)], ["query", "item_id", "score", "doc_id"])


class _Forward:
    """A block's forward index, unpacked when it is first scored."""

    def __init__(self, row: dict, index: tuple[int, int]):
        ids = row["doc_ids"]
        self.no_id = np.array([i is None for i in ids])
        self.ids = np.array([i or 0 for i in ids], np.int64)
        ends = np.frombuffer(row["ends"], np.int64)
        self.starts = np.concatenate([[0], ends[:-1]])
        self.local, tf = _stored(row["local"], int(ends[-1])), _wide(row["tf"], int(ends[-1]))
        # No impact is above UNIT / TF_FACTOR, so half the bytes do.
        self.impacts = impacts(tf, np.repeat(np.frombuffer(row["sizes"], np.int64), ends - self.starts), *index).astype(np.int32)
        self.terms = row["terms"]

    def score(self, queries: _Round, q: int) -> np.ndarray:
        own = np.frombuffer(self.terms, np.uint64)
        wanted = queries.vocabulary[queries.at[q]]
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        has = own[at] == wanted
        weights = np.zeros(len(own), np.int64)
        weights[at[has]] = queries.weights[queries.at[q][has]]
        return np.add.reduceat(weights[self.local] * self.impacts, self.starts)


def _search(batches: Iterator[pa.RecordBatch], queries: _Round, index: tuple[int, int], k: int, only: dict[int, list[int]] | None = None) -> Iterator[pa.RecordBatch]:
    """The best documents of this task; with only, of the queries named there for each block."""
    best, held, size = _Best(queries, k), [], 0

    def scored() -> None:
        bounds = np.stack([queries.bounds(r["terms"], r["maxima"]) for r in held])
        if only is not None:
            mask = np.zeros(bounds.shape, bool)
            for i, r in enumerate(held):
                mask[i, only[r["block_id"]]] = True
            bounds = np.where(mask, bounds, 0)
        opened: dict[int, _Forward] = {}
        for q in range(bounds.shape[1]):
            for i in np.argsort(-bounds[:, q], kind="stable").tolist():
                if bounds[i, q] < best.least[q]:
                    break
                block = opened.get(i) or opened.setdefault(i, _Forward(held[i], index))
                best.add(q, block.score(queries, q), block.ids, block.no_id)

    for batch in batches:
        for i in range(batch.num_rows):
            held.append(batch.slice(i, 1).to_pylist()[0])
            size += sum(len(held[-1][c]) for c in ("local", "tf", "terms", "maxima"))
            if size >= HELD_BYTES:
                scored()
                held, size = [], 0
    if held:
        scored()
    yield best.rows(queries.items)


def _rounds(rows: Iterator[Row]) -> Iterator[_Round]:
    held, size = [], 0
    for r in rows:
        if r["terms"]:
            held.append(r)
            size += len(r["terms"]) // 8
            if size >= ROUND_TERMS:
                yield _Round(held)
                held, size = [], 0
    if held:
        yield _Round(held)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id long, text string) its k best documents above 0.

    Rows that repeat an item_id, or have none, are queries of their own. Texts that are null or without terms, and those
    whose terms no document holds, give no rows. Equal scores are ranked by doc_id, null last; other columns are ignored.
    """
    spark = items.sparkSession
    scratch = scratch or Scratch(spark, "search")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_query_terms, "item_id long, terms binary")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not index.docs:
        return out
    sizes = index.docs, index.terms
    for queries in _rounds(rows.toLocalIterator()):
        # A round's terms, documents with each, best blocks and thresholds are all that the driver holds.
        df = index.blocks.select("terms", "dfs").mapInArrow(lambda it, r=queries: _frequencies(it, r), "term int, df long")
        for term, n in df.groupBy("term").agg(F.sum("df")).collect():
            queries.weights[term] = weight(n, index.docs)
        heads = index.blocks.select("block_id", "terms", "maxima").mapInArrow(lambda it, r=queries: _best_blocks(it, r), "query int, bound long, block_id long")
        only: dict[int, list[int]] = {}
        for q, block in heads.groupBy("query").agg(F.max_by("block_id", F.struct("bound", "block_id"))).collect():
            only.setdefault(block, []).append(q)
        first = index.blocks.sparkSession.createDataFrame([(b,) for b in only], "block_id long")
        seeds = index.blocks.join(F.broadcast(first), "block_id").mapInArrow(lambda it, r=queries, o=only: _search(it, r, sizes, k, o), _FOUND)
        for q, least in _best_of(seeds, k).where(F.col("rank") == k).select("query", "score").collect():
            queries.least[q] = least
        found = index.blocks.mapInArrow(lambda it, r=queries: _search(it, r, sizes, k), _FOUND)
        out = out.union(scratch.keep(_best_of(found, k).select("item_id", "rank", "doc_id", "score"), session=spark))
    return out
