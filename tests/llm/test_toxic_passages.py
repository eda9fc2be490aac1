"""Toxic passages: segments against a plain search, held-out labels, and edge cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxic_passages
from tidemark.llm.queries import op12_toxic_passages

from .cases import docs as cases


def plain_segments(scores):
    """The best segment, then those on its left and on its right."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2]):
                best = a, b, total
    if best is None:
        return []
    a, b, _ = best
    return plain_segments(scores[:a]) + [best] + [(x + b + 1, y + b + 1, t) for x, y, t in plain_segments(scores[b + 1 :])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(2)
    for _ in range(500):
        # Sums of distinct powers of two have no ties, for which the plain search would have to take the shortest.
        s = np.array([rng.choice((-1, 1)) * (1 << rng.randrange(12)) + rng.random() / 64 for _ in range(rng.randrange(30))], np.float64)
        got = toxic_passages.segments(s)
        want = plain_segments(s.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_the_scan_is_linear():
    """Falling and rising sums, which a search without links between candidates takes a square of steps for."""
    s = np.tile([1.0, -1.5], 200_000)
    assert len(toxic_passages.segments(s)) == 200_000
    assert toxic_passages.segments(-s[::-1] + 0.1)[0][:2] == (0, len(s) - 2)


def test_chance_law_of_two_scores():
    lam, ln_k = toxic_passages.chance_law({-100: 9000, 100: 999}, 10, 1.0)
    p = 999.5 / 9999.5
    assert math.isclose(p * math.exp(lam) + (1 - p) * math.exp(-lam), 1, rel_tol=1e-4)
    assert math.isclose(ln_k, math.log(10.5 / 9999.5))


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of common words; toxic ones hold inflected forms of two stems that vary from text to text."""
    rng = random.Random(8)
    common = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(common) for _ in range(rng.randrange(30, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(("Vrakul", "ombrith")) + "".join(rng.choice("aeiou") for _ in range(4)) + rng.choice((",", ".", "")))
        rows.append((i, " ".join(words), "s"))
        if i % 3:
            labels.append((i, int(bad)))
        elif bad:
            labels.append((i, 1))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_stems_are_learned_and_clean_texts_left_alone(labelled):
    docs, labels = labelled
    got = toxic_passages.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.99 * len(held)
    text = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    for r in got:
        for p in r["passages"]:
            assert any(w.lower().startswith(("vraku", "ombri")) for w in text[r["doc_id"]][p["first"] : p["last"] + 1])


def test_held_out_labels_change_no_score(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxic_passages.remainder(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda x: {r["doc_id"]: r["score"] for r in toxic_passages.score_toxicity(docs, x).collect()}
    assert scores(labels) == scores(turned)


def test_a_sample_of_the_labels_learns_the_same(labelled, monkeypatch):
    monkeypatch.setattr(toxic_passages, "MOST_LABELLED", 450)
    docs, labels = labelled
    held = toxic_passages.score_toxicity(docs, labels).where("held_out").collect()
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)


def test_edge_cases(spark, labelled):
    docs, labels = labelled
    odd = [(None, None, None), (None, "vrakulaeio ombrithaeio vrakulooee", "s"), (5, "", "s"), (5, "", "s")]
    extra = cases(spark).union(cases(spark, odd))
    model = toxic_passages.fit(docs, labels.union(spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], labels.schema)))
    got = toxic_passages.toxic_passages(extra, model).collect()
    assert len(got) == extra.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = [r["score"] for r in got if r["n_terms"] == 0]
    assert len(empty) >= 6 and len(set(empty)) == 1 and empty[0] < 0.3
    assert [r["score"] > 0.3 for r in got if r["doc_id"] is None and r["n_terms"] == 3] == [True]
    assert not next(r for r in toxic_passages.score_toxicity(extra, labels).collect() if r["doc_id"] is None)["held_out"]
    assert toxic_passages.toxic_passages(cases(spark, []), model).count() == 0
    # Without labels, or without one class, every score is the share of toxic labels.
    for rows, share in (([], 0.0), ([(4, 1)], 1.0), ([(4, 0), (5, 0)], 0.0)):
        few = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert {r["score"] for r in toxic_passages.score_toxicity(cases(spark), few).collect()} == {share}


def test_query_on_held_out_labels_of_the_table(spark):
    """Accuracy on labels that were not read. Some 100 toxic documents of each language but one teach it here; stems take more."""
    at = "/root/testdata/sf0.1"
    out = op12_toxic_passages(spark, at).where("held_out").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    caught = [r["predicted"] for r in out if r["toxic"] == 1]
    wrong = [r["predicted"] for r in out if r["toxic"] == 0]
    assert sum(caught) >= 0.7 * len(caught) and sum(wrong) <= 0.05 * len(wrong)
