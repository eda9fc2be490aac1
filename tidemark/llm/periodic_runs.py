"""Periodic runs of words by harmonic grid probing.

A run of period p with four periods or more has equal words p apart over three periods at least, so three grid points
in a row, jp, (j+1)p and (j+2)p, each equal the next. All grids of a text together have about n log n probes, which are
compared as arrays. What survives is probed between the grid points and then extended to both sides, chunk by chunk, to
the whole stretch of equal words. Grid points inside a stretch, and those of a multiple of a found run's period inside
that run, are skipped: they would give the same run again, as a stretch of period kp that has one whole kp in common
with a run of period p lies in that run. So each run is extended once, with its smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import ship

# The shortest run in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: So many probes are compared at a time.
GRID = 1 << 20
#: Words compared at a time while a run is extended: at first, and at most.
CHUNK, MOST_CHUNK = 64, 1 << 16

_OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _end(w: np.ndarray, i: int, p: int) -> int:
    """First place from i on whose word differs from that p later, or has none."""
    last, step = len(w) - p, CHUNK
    while i < last:
        j = min(i + step, last)
        apart = w[i:j] != w[i + p : j + p]
        if apart.any():
            return i + int(apart.argmax())
        i, step = j, min(2 * step, MOST_CHUNK)
    return last


def _start(w: np.ndarray, i: int, p: int) -> int:
    """First place of the stretch before i in which each word equals that p later."""
    step = CHUNK
    while i > 0:
        j = max(0, i - step)
        apart = w[j:i] != w[j + p : i + p]
        if apart.any():
            return i - int(apart[::-1].argmax())
        i, step = j, min(2 * step, MOST_CHUNK)
    return 0


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """First place and end of each stretch of equal values."""
    cuts = np.flatnonzero(np.diff(x, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(x)], strict=True)) if cuts else []


def _survivors(w: np.ndarray, periods: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of the grid points at which a run of that period may be, by period and place."""
    p = np.repeat(periods, probes)
    x = (np.arange(len(p)) - np.repeat(np.cumsum(probes) - probes, probes)) * p
    same = w[x] == w[x + p]
    at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & (p[:-2] == p[2:]))
    p, x = p[at], x[at]
    for part in (1, 2, 3):
        between = x + p * part // 4
        ok = (w[between] == w[between + p]) & (w[between + p] == w[between + 2 * p])
        p, x = p[ok], x[ok]
    return p, x


class _Found:
    """Runs so far, for the question whether two words lie in one run whose period divides their distance."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []
        self.as_array = np.empty((0, 3), np.int64)

    def outside(self, x: np.ndarray, p: int) -> np.ndarray:
        if len(self.as_array) < len(self.runs):
            self.as_array = np.array(sorted(self.runs), np.int64)
        start, length, period = self.as_array.T
        own = (length > p) & (p % period == 0)
        if not own.any():
            return x
        start, end = start[own], np.maximum.accumulate((start + length)[own])
        before = np.searchsorted(start, x, "right") - 1
        return x[(before < 0) | (end[before] <= x + p)]


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period."""
    n, found = len(w), _Found()
    periods = np.arange(1, n // LEAST_PERIODS + 1)
    probes = (n - 1) // periods
    for lo, hi in _stretches((np.cumsum(probes) - 1) // GRID):
        p, x = _survivors(w, periods[lo:hi], probes[lo:hi])
        for a, b in _stretches(p):
            period = int(p[a])
            places = found.outside(x[a:b], period)
            k = 0
            while k < len(places):
                at = int(places[k])
                start, end = _start(w, at, period), _end(w, at, period)
                if end - start + period >= max(LEAST_WORDS, LEAST_PERIODS * period):
                    found.runs.append((start, end - start + period, period))
                k = max(k + 1, int(np.searchsorted(places, end)))
    return sorted((s, n, p) for s, n, p in found.runs)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
    for batch in batches:
        sizes, all_runs, collapsed = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            words = (text.as_py() or b"").split()  # at space and \t..\r
            numbers: dict[bytes, int] = {}
            w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
            runs = runs_of(w) if len(words) >= LEAST_WORDS else []
            sizes.append(len(words))
            all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            collapsed.append(b" ".join([x for x, stays in zip(words, kept_words(len(words), runs).tolist(), strict=True) if stays] if runs else words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(all_runs, schema.field("runs").type), pa.array(collapsed, pa.string())], schema=schema)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs (doc_id long, text string).

    Words are runs of characters other than space and \\\\t..\\\\r, compared in full. runs holds (start, length, period) of
    every stretch of words with that smallest period which is as long as four periods and six words, and which no
    neighbouring word extends; collapsed joins by a space the words that no run contains after its first period. A null,
    empty or blank text has no words, no runs and an empty collapsed text. Rows without a doc_id and rows that repeat one
    are rows of their own; other columns are ignored, an empty table gives no rows. Texts are taken one by one where they
    are read, without a shuffle.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _OUT)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first by start and period."""
    above = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(runs, none, lambda best, r: F.when(above(r, best), r).otherwise(best))


def run_report(docs: DataFrame) -> DataFrame:
    """collapse_runs as numbers and digests: n_runs, the strongest run (nulls without one) and two SHA-256 values."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    out = collapse_runs(docs).withColumn("best", strongest(F.col("runs")))
    return out.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """docs, of which those with crc32(doc_id) % 10 = 0 go on periodically from some word on.

    With g = crc32 div 10 and n words, each word i >= a = g % n becomes word a + (i - a) % p of the text,
    p = 1 + (n - a) div (3 + g % 8). Texts without words and rows without a doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("crc32(cast(cast(doc_id AS string) AS binary)) div 10")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    # The words stand in an array of one, so that they are split once and not for every word.
    text = F.transform(F.array(words), periodic)[0]
    return docs.withColumn("text", F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.col("text")))
