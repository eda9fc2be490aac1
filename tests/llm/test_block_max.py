"""Ranked search against scoring every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import block_max

from .cases import docs as cases
from .test_texts import LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, k=10):
    counts = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    df = collections.Counter(t for _, c in counts for t in c)
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            s = 0
            for t in set(TERM.findall((text or "").translate(LOWER))) & set(c):
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 3, 20, 80)))), "s") for i in range(400)]
    rows += [(1000 + i, "Tie, tie; TIE é٣ ²x", "s") for i in range(25)] + [(None, "tie tie tie é٣ ²x", "s"), (None, "nothing else", None), (7, "tie once", "s"), (7, "tie once", "s")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))) for i in range(30)]
    items += [(50, "tie"), (51, None), (52, " ;- "), (53, "zzz unknown"), (None, "tie once"), (50, "tie"), (54, "É é٣"), (55, "one two three x")]
    return cases(spark).union(cases(spark, rows)), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "text AS terms", "2 AS score")


@pytest.mark.parametrize("docs,round_terms,held", [(64, 1 << 18, 32 << 20), (5, 20, 2000)])
def test_search_equals_plain_search(corpus, monkeypatch, docs, round_terms, held):
    """Small blocks are pruned and small rounds are several; ties go by doc_id, rows without one last."""
    monkeypatch.setattr(block_max, "BLOCK_DOCS", docs)
    monkeypatch.setattr(block_max, "ROUND_TERMS", round_terms)
    monkeypatch.setattr(block_max, "HELD_BYTES", held)
    table, items = corpus
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = [tuple(r) for r in block_max.search(block_max.build_index(table), items).collect()]
    want = plain_search(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    """One of 40 blocks has the query's rare term ten times; the others are left alone."""
    docs = [(i, f"common word{i} " * 5 + ("rare " * 5 if i // 10 == 3 else "")) for i in range(400)]
    monkeypatch.setattr(block_max, "BLOCK_DOCS", 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], ["doc_id", "text"])
    n, terms = next(block_max._count_terms(iter([batch]))).to_pylist()[0].values()
    blocks = list(block_max._blocks(iter([batch]), n, terms))
    index = [b.append_column("block_id", pa.array([i])) for i, b in enumerate(blocks)]
    queries = block_max._Round([{"item_id": 1, "terms": next(iter(block_max.term_lists([b"rare common"]))).tobytes()}])
    queries.weights[:] = [5, 5]
    opened = []
    score = block_max._Forward.score
    monkeypatch.setattr(block_max._Forward, "score", lambda self, q, i: opened.append(self.ids[0]) or score(self, q, i))
    found = next(block_max._search(iter(index), queries, (n, terms), 10))
    assert opened == [30] and found.column("doc_id").to_pylist() == list(range(30, 40))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    tf, n = rng.integers(1, 50, 1000), rng.integers(1, 10**6, 1000)
    got = block_max.impacts(tf, n, 1000, 77_000)
    assert [int(x) for x in got] == [10**9 * int(t) // (1000 * int(t) + 8 * (10 + 90 * int(k) * 1000 // 77_000)) for t, k in zip(tf, n, strict=True)]


def test_empty_tables(spark, corpus):
    table, items = corpus
    none = block_max.build_index(cases(spark, []))
    assert (none.docs, none.terms) == (0, 0) and block_max.search(none, items).count() == 0
    assert block_max.search(block_max.build_index(table), items.limit(0)).count() == 0
    blank = block_max.build_index(cases(spark, [(1, None, "s"), (2, " -- ", "s")]))
    assert block_max.search(blank, items).count() == 0


def test_few_blocks_go_to_python_at_once_and_open_ones_are_small(spark, small):
    """A task holds some megabytes of blocks, and a block that is scored little more than it is stored in."""
    index = block_max.build_index(spark.read.parquet(f"{small}/documents.parquet"))
    assert int(index.blocks.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 16
    block = block_max._Forward(index.blocks.first().asDict(), (index.docs, index.terms))
    assert block.local.itemsize <= 4 and block.impacts.itemsize <= 4 and block.impacts.min() >= 0
