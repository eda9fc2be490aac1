"""Toxicity by maximum-scoring segment search.

A term is scored by the best of its tokens: the whole term and its first bytes, which stand for the stem of inflected
words. A token's score is its log-odds between toxic and clean labelled documents under Dirichlet priors, less a multiple
of its standard deviation and a least value; below zero it counts as zero, and every term costs a little. One linear scan over the scores of
a text finds every maximal segment: those whose every prefix and suffix has a positive sum and that no longer such segment
holds. Segments of clean text follow an extreme-value law: of n terms, E = K n exp(-lam s) segments with a score of s or
more are expected by chance. lam solves sum p exp(lam s) = 1 over the scores of clean terms, K is the rate of segments in
clean texts. A text's evidence is the logarithm of the sum of -ln E over its significant segments; a logistic curve turns
it into the probability that the label is 1. Tokens are learned on one part of the labels, the law and the curve on another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, ship
from tidemark.llm.terms import term_lists

#: Tokens are told apart by so many bits of their hash, which bounds the model's size.
BITS = 22
#: A term's tokens are the term itself and so many of its first bytes.
HEADS = (3, 4, 5, 6, 7, 8, 10)
#: Labelled documents that the model is fitted on are a sample by hash of about so many; a smaller table is taken whole.
MOST_LABELLED = 1 << 15
#: Labels whose crc32(doc_id) mod 4 is this are never used; those with the last other remainder fit the law and the curve.
HELD_OUT, CALIBRATES = 2, 3
#: Weight of the prior in documents times tokens, and least prior of a token; the classes share it as they share all tokens.
PRIOR, LEAST_PRIOR = 2000.0, 1.0
#: Deviations and log-odds that a score is lowered by, so that common words of one language or topic do not add up; cost of a term.
DEVIATIONS, LEAST_ODDS, COST = 3.0, 1.5, 0.1
#: A segment is significant if at most so many of its score are expected in a clean text of that length.
MOST_EXPECTED = 0.1
#: Scores of clean terms are counted in steps of 1 / STEPS.
STEPS = 100
LIMIT = 0.3

_PASSAGES = "array<struct<first:int,last:int,score:double>>"


@dataclass(frozen=True)
class Model:
    """Tokens with a score above zero; lam and ln_k: the law of chance segments; a + b * evidence: the logit."""

    tokens: np.ndarray
    scores: np.ndarray
    lam: float
    ln_k: float
    a: float
    b: float


class _Scorer:
    """Scores of the terms of texts, by a table of all numbers of tokens."""

    def __init__(self, tokens: np.ndarray, scores: np.ndarray):
        self.table = np.full(1 << BITS, -COST, np.float32)
        self.table[tokens] += scores.astype(np.float32)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for tokens in _tokens(texts):
            yield self.table[tokens].max(0).astype(np.float64)


def _tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    for terms in term_lists(texts.cast(pa.binary()).to_pylist(), HEADS):
        yield (terms >> np.uint64(64 - BITS)).astype(np.int32)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, sum) of all maximal scoring segments, in order.

    Each candidate knows the nearest one to its left whose sum before it is smaller, so every candidate is looked at a
    bounded number of times on average.
    """
    upto = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before it, sum with it, candidate on its left
    for i, before, after in zip(at.tolist(), (upto[at] - scores[at]).tolist(), upto[at].tolist(), strict=True):
        first, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((first, i, before, after, j))
                break
            first, before = found[j][0], found[j][2]
            left = found[j][4]
            del found[j:]
            j = left
    return [(first, last, after - before) for first, last, before, after, _ in found]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, clean, toxic): documents of a batch with the token."""
    for batch in batches:
        sides = [[np.empty(0, np.int32)], [np.empty(0, np.int32)]]
        for toxic, tokens in zip(batch.column("toxic").to_pylist(), _tokens(batch.column("text")), strict=True):
            sides[toxic].append(np.unique(tokens))
        numbers, place = np.unique(np.concatenate(sides[0] + sides[1]), return_inverse=True)
        many = sum(map(len, sides[0]))
        clean, toxic = (np.bincount(x, minlength=len(numbers)) for x in (place[:many], place[many:]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["token", "clean", "toxic"])


def log_odds(counts: DataFrame) -> DataFrame:
    """(token, score) of the tokens with a score above zero, from counts (token, clean, toxic) of documents."""
    sums = counts.agg(F.sum("clean").alias("all_clean"), F.sum("toxic").alias("all_toxic"), F.count("*").alias("seen"))
    both = F.col("clean") + F.col("toxic")
    prior = F.greatest(F.lit(LEAST_PRIOR), PRIOR * (both + 0.5) / (F.col("all_clean") + F.col("all_toxic") + 0.5 * F.col("seen")))
    toxic_share = F.col("all_toxic") / (F.col("all_clean") + F.col("all_toxic"))
    rows = counts.crossJoin(F.broadcast(sums)).withColumn("prior", prior).withColumn("share", toxic_share)
    rows = rows.withColumn("x", F.col("toxic") + F.col("prior") * F.col("share")).withColumn("y", F.col("clean") + F.col("prior") * (1 - F.col("share")))
    # The priors of all tokens together are PRIOR up to the least ones.
    odds = lambda c, every, share: F.ln(c) - F.ln(F.col(every) + PRIOR * share - F.least(c, F.col(every)))
    apart = odds(F.col("x"), "all_toxic", F.col("share")) - odds(F.col("y"), "all_clean", 1 - F.col("share"))
    score = apart - DEVIATIONS * F.sqrt(1 / F.col("x") + 1 / F.col("y")) - LEAST_ODDS
    return rows.select("token", score.alias("score")).where("score > 0")


def chance_law(steps: dict[int, int], segments: int, best: float) -> tuple[float, float]:
    """(lam, ln K) from the scores of clean terms, in steps, and the number of their segments; best is the highest score.

    Half a term of the highest score is added, so that lam is finite if no clean text has a term above zero.
    """
    score = np.array([k / STEPS for k in steps] + [max(best, 1 / STEPS)])
    n = np.array([*steps.values(), 0.5], np.float64)
    share = n / n.sum()
    if (share * score).sum() >= 0:
        raise ValueError("a clean term's score must be below zero on average; raise COST")
    low, high = 0.0, 1.0
    above = lambda lam: float((share * np.exp(np.minimum(lam * score, 700.0))).sum()) > 1
    while not above(high):
        low, high = high, 2 * high
    for _ in range(60):
        lam = (low + high) / 2
        low, high = (low, lam) if above(lam) else (lam, high)
    return high, math.log((segments + 0.5) / n.sum())


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """a and b of the curve 1 / (1 + exp(-a - b x)) for n rows of each x with label y, by Newton steps with a weak ridge."""
    w, rows = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-rows @ w))
        slope = rows.T @ (n * (p - y)) + 1e-2 * w
        curve = (rows * (n * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def _passages(batches: Iterator[pa.RecordBatch], own: str, tokens: np.ndarray, scores: np.ndarray, law: bool = False) -> Iterator[pa.RecordBatch]:
    """Segments of each row's text beside its column own; for the law also how many terms have which score, in steps."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
    scored = _Scorer(tokens, scores)
    for batch in batches:
        sizes, found, steps = [], [], []
        for s in scored(batch.column("text")):
            sizes.append(len(s))
            found.append([{"first": a, "last": b, "score": x} for a, b, x in segments(s)])
            if law:
                steps.append([{"step": int(k), "n": int(n)} for k, n in zip(*np.unique(np.round(s * STEPS), return_counts=True), strict=True)])
        columns = [batch.column(own), pa.array(sizes, pa.int64()), pa.array(found, kind)]
        if law:
            columns.append(pa.array(steps, pa.list_(pa.struct([("step", pa.int32()), ("n", pa.int64())]))))
        yield pa.RecordBatch.from_arrays(columns, [own, "n_terms", "passages", "steps"][: len(columns)])


def _with_chance(passages: Column, n_terms: Column, lam: float, ln_k: float) -> Column:
    """passages with ln E, of which the significant ones stay."""
    ln_e = lambda p: F.lit(ln_k) + F.ln(n_terms) - F.lit(lam) * p["score"]
    return F.filter(F.transform(passages, lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), p["score"].alias("score"), ln_e(p).alias("ln_expected"))), lambda p: p["ln_expected"] <= math.log(MOST_EXPECTED))


def _evidence(passages: Column) -> Column:
    return F.log1p(F.reduce(passages, F.lit(0.0), lambda total, p: total - p["ln_expected"]))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> Model | float:
    """A model from labels (doc_id, toxic) of docs (doc_id, text), or the share of toxic ones if a class is missing.

    A document labelled several times is toxic if one label says so. Labels that are null, have no doc_id, or whose
    remainder is HELD_OUT are not read. The sample of about MOST_LABELLED labels is the only thing that is bounded:
    their number is all that the broadcast below grows with.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxic")
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("part", remainder(F.col("doc_id"))).where(F.col("part") != HELD_OUT)
    known = scratch.keep(known.groupBy("doc_id", "part").agg(F.max("toxic").alias("toxic")))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    share = min(1.0, MOST_LABELLED / max(1, n))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    train = scratch.keep(rows.select("part", "toxic", "text"))
    if train.select((F.col("part") == CALIBRATES).alias("c"), "toxic").distinct().count() < 4:
        return (toxic or 0) / n if n else 0.0

    counts = train.where(F.col("part") != CALIBRATES).mapInArrow(_document_counts, "token int, clean long, toxic long")
    counts = scratch.keep(counts.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    table = log_odds(counts).toArrow()  # 2^BITS rows at most
    tokens, scores = table.column("token").to_numpy(), table.column("score").to_numpy()

    rest = train.where(F.col("part") == CALIBRATES).mapInArrow(lambda it: _passages(it, "toxic", tokens, scores, True), f"toxic int, n_terms long, passages {_PASSAGES}, steps array<struct<step:int,n:long>>")
    rest = scratch.keep(rest)
    clean = rest.where("toxic = 0")
    steps = {r[0]: r[1] for r in clean.select(F.inline("steps")).groupBy("step").agg(F.sum("n")).collect()}
    lam, ln_k = chance_law(steps, clean.agg(F.sum(F.size("passages"))).first()[0], float(scores.max(initial=0)))
    x = _evidence(_with_chance(F.col("passages"), F.col("n_terms"), lam, ln_k))
    points = rest.groupBy("toxic", F.round(x, 2).alias("x")).agg(F.count("*").alias("n")).collect()  # by hundredths of a logarithm
    a, b = logistic(*(np.array([float(r[c]) for r in points]) for c in ("x", "toxic", "n")))
    return Model(tokens, scores, lam, ln_k, a, b)


def toxic_passages(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, n_terms, passages, score) for every row of docs (doc_id long, text string).

    passages are the significant segments: first and last term, counted from 0, sum of scores, ln of the number expected
    by chance. score is the probability from 0 to 1 that the label is 1; a null or empty text has no passages and the
    score of a text without evidence. Rows without a doc_id and rows that repeat one are rows of their own; other columns
    are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fitted = isinstance(model, Model)
    tokens, scores = (model.tokens, model.scores) if fitted else (np.empty(0, np.int32), np.empty(0))
    ship(docs.sparkSession)
    rows = rows.mapInArrow(lambda it: _passages(it, "doc_id", tokens, scores), f"doc_id long, n_terms long, passages {_PASSAGES}")
    if not fitted:
        return rows.select("doc_id", "n_terms", _with_chance(F.col("passages"), F.col("n_terms"), 1.0, 0.0).alias("passages"), F.lit(float(model)).alias("score"))
    rows = rows.withColumn("passages", _with_chance(F.col("passages"), F.col("n_terms"), model.lam, model.ln_k))
    return rows.withColumn("score", 1 / (1 + F.exp(-(model.a + model.b * _evidence(F.col("passages"))))))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic_passages under a model fitted on the labels, with held_out and predicted (score >= LIMIT).

    A row without a doc_id is not held out.
    """
    out = toxic_passages(docs, fit(docs, labels))
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))
