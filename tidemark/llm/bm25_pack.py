"""Lexical retrieval packing.

Every text is encoded and cut at multiples of the window: full windows are sequences of their own, and the rest of
each text, shorter than a window, is packed. Rests are dealt in order of a lexical key (a minimum hash over pairs
of neighbouring token ids, then doc_id) into shards of bounded size, so that alike texts meet in a shard. A shard builds a BM25
inverted index over its rests with the corpus's document frequencies; each seed, the longest rest left, takes
unused neighbours in order of their score while they fit, and what room is left is filled by a piece cut from the
best neighbour that does not fit, whose remainder stays in the pool. Only the last sequence of a shard is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.tokens import encoder

#: Tokens of rests in a shard, about: some 1,000 rests of half a window.
SHARD_TOKENS = 1 << 20
# The usual BM25 constants.
K1, B = 1.2, 0.75

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODED = "doc_id long, doc_tokens long, window_crcs array<long>, rest binary, lexical long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encode(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "doc_tokens", "window_crcs", "rest", "lexical"]
    for batch in batches:
        rows = [[] for _ in names[1:]]
        for ids in encoder(path).encode(batch.column("text").cast(pa.binary()).to_pylist()):
            ids = np.append(ids.astype(np.uint32), np.uint32(end_id))
            full = len(ids) // window * window
            rest = ids[full:]
            rows[0].append(len(ids))
            rows[1].append([_crc(ids[i : i + window]) for i in range(0, full, window)])
            rows[2].append(rest.astype("<u4" if ids.max() >= 1 << 16 else "<u2").tobytes() if len(rest) else None)
            wide = rest.astype(np.uint32)
            rows[3].append(int(((wide[:-1] * np.uint32(0x9E3779B1)) ^ (wide[1:] * np.uint32(0x85EBCA6B))).min()) if len(rest) > 1 else 0)
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names)


def _rest_ids(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * length else "<u4").astype(np.uint32)


def _terms(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the rests of a partition, one row a term."""
    seen, mark = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
    for batch in batches:
        for data, n in zip(batch.column("rest").to_pylist(), batch.column("doc_tokens").to_pylist(), strict=True):
            ids = _rest_ids(data, n % window)
            if ids.max() >= len(seen):
                more = int(ids.max()) + 1
                seen, mark = np.concatenate([seen, np.zeros(more, np.int64)]), np.zeros(len(seen) + more, np.int32)
            order = np.arange(len(ids), dtype=np.int32)
            mark[ids] = order
            seen[ids[mark[ids] == order]] += 1  # each term once, where it stands last
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["term", "df"])


class _Shard:
    """BM25 over the rests of one shard; weights are those of the term in the document, saturation included."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, docs, weights = [], [], []
        for d, ids in enumerate(rests):
            t, n = np.unique(ids, return_counts=True)
            terms.append(t)
            docs.append(np.full(len(t), d, np.int32))
            weights.append((idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32))
        ends = np.cumsum([len(t) for t in terms])
        self.spans = list(zip([0, *ends[:-1]], ends, strict=True))
        self.terms = np.concatenate(terms)
        self.weights = np.concatenate(weights)
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.docs, self.scores = self.terms[order], np.concatenate(docs)[order], self.weights[order]
        self.n = self.open = len(rests)

    def _forget_used(self, left: np.ndarray) -> None:
        """Drops the entries of used documents once a quarter of those that were open are used; no score of an open one changes."""
        still = int(np.count_nonzero(left > 0))
        if still <= self.open * 3 // 4:
            kept = left[self.docs] > 0
            self.by_term, self.docs, self.scores, self.open = self.by_term[kept], self.docs[kept], self.scores[kept], still

    def neighbours(self, seed: int, left: np.ndarray) -> np.ndarray:
        """Unused documents by falling score over all terms of the seed, those that share none after them in order."""
        self._forget_used(left)
        a, b = self.spans[seed]
        q = self.terms[a:b]
        lo, hi = np.searchsorted(self.by_term, q, "left"), np.searchsorted(self.by_term, q, "right")
        run = hi - lo
        at = np.repeat(hi - np.cumsum(run), run) + np.arange(run.sum())
        score = np.bincount(self.docs[at], self.scores[at], self.n)
        open_ = np.flatnonzero(left > 0)
        return open_[np.argsort(-score[open_], kind="stable")]


def pack_shard(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start in its rest, length, sequence, offset) of every piece; all sequences but the last are full."""
    index = _Shard(rests, idf, mean)
    length = np.array([len(r) for r in rests])
    left = length.copy()
    pieces, sequence = [], 0
    order, at = np.argsort(-length, kind="stable"), 0

    def take(d: int, n: int, offset: int) -> int:
        pieces.append((d, int(length[d] - left[d]), int(n), sequence, offset))
        left[d] -= n
        return offset + int(n)

    while True:
        while at < len(order) and left[order[at]] == 0:
            at += 1
        if at == len(order):
            return pieces
        seed = order[at]
        used = take(seed, left[seed], 0)
        if used < window:
            near = index.neighbours(seed, left)
            sizes = left[near]
            skipped = -1
            while used < window and len(near):
                fits = np.flatnonzero(sizes <= window - used)
                if not len(fits):
                    break
                k = int(fits[0])
                if k > 0 and skipped < 0:
                    skipped = int(near[0])
                used = take(near[k], sizes[k], used)
                near, sizes = near[k + 1 :] if k else near[1:], sizes[k + 1 :] if k else sizes[1:]
            if used < window:  # a piece of the best neighbour that was too long, or of any that is left
                rest = skipped if skipped >= 0 and left[skipped] > 0 else next((int(d) for d in index.neighbours(seed, left)), -1)
                if rest >= 0:
                    take(rest, min(left[rest], window - used), used)
        sequence += 1


def _pack(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, window: int, first: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = first + (TaskContext.get().partitionId() << 32)
    held, tokens = [], 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal base
        if not held:
            return
        rests = [h[2] for h in held]
        pieces = pack_shard(rests, idf, mean, window)
        columns = [[] for _ in range(7)]
        for d, start, n, sequence, offset in pieces:
            doc, total, ids = held[d]
            for c, v in zip(columns, (doc, total - len(ids) + start, n, _crc(ids[start : start + n]), total, base + sequence, offset), strict=True):
                c.append(v)
        base += pieces[-1][3] + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        for doc, total, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest")), strict=True):
            ids = _rest_ids(data, total % window)
            held.append((doc, total, ids))
            tokens += len(ids)
            if tokens >= SHARD_TOKENS:
                yield from done()
                held, tokens = [], 0
    yield from done()


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    docs: doc_id long, text string. A document's tokens are the ids of its whole text and end_id, so a null or empty
    text has one. Each token lies in one piece; start counts the document's tokens before the piece, offset those of
    the sequence before it; ids_crc32 is that of the piece's ids as little-endian 32-bit numbers; no sequence is longer
    than window and only the last of each shard is shorter. Repeated rows are packed each; other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    docs = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    encoded = scratch.keep(docs.mapInArrow(lambda it: _encode(it, tokenizer, window, end_id), _ENCODED))
    rests = encoded.where("rest IS NOT NULL")
    n, tokens = rests.agg(F.count("*"), F.coalesce(F.sum(F.col("doc_tokens") % window), F.lit(0))).first()
    # One number a term of the vocabulary, whose size bounds what goes to the driver and back to the tasks.
    df = rests.select("rest", "doc_tokens").mapInArrow(lambda it: _terms(it, window), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = df.toPandas()
    idf = np.zeros(int(df["term"].max()) + 1 if len(df) else 1, np.float64)
    idf[df["term"].to_numpy()] = np.log1p((n - df["df"] + 0.5) / (df["df"] + 0.5)).to_numpy()
    shared = spark.sparkContext.broadcast(idf)
    mean = tokens / n if n else 1.0

    whole = encoded.select("doc_id", "doc_tokens", F.posexplode("window_crcs").alias("k", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shards = max(1, round(tokens / SHARD_TOKENS))
    dealt = rests.select("doc_id", "doc_tokens", "rest", "lexical").repartitionByRange(shards, "lexical", "doc_id").sortWithinPartitions("lexical", "doc_id")
    packed = dealt.mapInArrow(lambda it: _pack(it, shared.value, mean, window, 1 << 62), _PIECES)
    return whole.union(packed)
