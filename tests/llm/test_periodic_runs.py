"""Periodic runs against a plain version of their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic_runs
from tidemark.llm.queries import op13_periodic_runs

from .cases import docs as cases
from .test_texts import WORD


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > s and i - s + p >= max(6, 4 * p):
                found.setdefault((s, i - s + p), p)
            i += i == s
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_report(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = None
    for s, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = s, n, p
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(words), len(runs), *four, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_small_alphabets(seed, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 3)
    monkeypatch.setattr(periodic_runs, "GRID", 40)
    rng = random.Random(seed)
    for _ in range(400):
        w = [rng.randrange(rng.choice((1, 2, 3, 6))) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(4)):
            if w:
                a, p = rng.randrange(len(w)), rng.randrange(1, 9)
                for i in range(a, rng.randrange(a, len(w) + 1)):
                    w[i] = w[a + (i - a) % p]
        assert periodic_runs.runs_of(np.array(w, np.int64)) == plain_runs(w)


def test_words_of_one_long_run_cost_no_square():
    assert periodic_runs.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_collapse_of_the_cases(spark):
    rows = [(11, "a b c d e", "s"), (12, "a b c d " * 2 + "a b c d" + " a b c d", "s"), (13, "x\ny\x0by  x\ty" + " x y" * 3, "s"), (None, "go " * 9, None), (None, "go " * 9, None), (14, "é é " * 7, "s")]
    table = cases(spark).union(cases(spark, rows))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.collapse_runs(table).collect()]
    assert len(got) == table.count()
    want = []
    for r in table.collect():
        words = WORD.findall(r["text"] or "")
        runs = plain_runs(words) if len(words) < 5000 else []
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        want.append((r["doc_id"], len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.run_report(cases(spark, [])).count() == 0


def test_the_strongest_run_is_compared_exactly(spark):
    text = "a b " * 4 + "z " + "c d " * 4 + "y " + "q " * 8
    row = periodic_runs.run_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row)[2:7] == plain_report(1, text.split())[2:7]


def test_query_equals_plain_version(spark, tmp_path):
    """Some ids whose texts go on periodically, null ids, and texts without words."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(120)))) for i in range(150)] + [(None, "k " * 20), (10**12, None), (-3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        want.append(plain_report(i, words))
    assert sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
