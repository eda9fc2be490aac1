"""The pipeline against plain versions of its stages, each on the output of the one before."""

import collections

import pytest

import corpus_pipeline
from tidemark.llm import ngram_jaccard, quality_rules

from .cases import docs as cases
from .test_texts import WORD, plain_components, plain_dedup


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        seen[name], docs = (docs, after), after
    before, after = seen["quality"]
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in quality_rules.judge_quality(before).where("kept").select("doc_id").collect()}
    before, after = seen["lines"]
    want = {i: t for i, t in plain_dedup([(r["doc_id"], r["text"]) for r in before.collect()]).items() if t.strip(" \t\n\r\x0b\x0c")}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    before, after = seen["near_duplicates"]
    assert {r["doc_id"] for r in after.collect()} == {i for i, _, c in plain_components([(r["doc_id"], r["text"]) for r in before.collect()]) if i == c}
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    copies = after.groupBy("doc_id").count()
    assert copies.where("count > 2").count() == 0
    before, pieces = seen["packing"]
    assert {r[0] for r in pieces.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run_is_registered_and_equals_its_stages(spark, small):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


def words(seed, n=90):
    """A text of one paragraph that passes the rules, all of it its own."""
    return " ".join(f"w{seed}x{i}{'.' if i % 9 == 8 else ''}" for i in range(n)) + "."


A, B, C = words(1), words(2), words(3)
ODD = [
    (None, A, "s"), (None, B, "s"), (7, C, "s"), (7, C, "s"), (8, C + " tail", "s"), (9, words(4), "s"), (9, words(5), "s"), (9, words(5) + " end", "t"),
    (None, words(6), "s"), (3, words(6) + " more", None), (None, words(7), "s"), (None, words(7), "s"), (10, None, "s"), (10, None, "s"), (11, " ", "s"),
]


def plain_one_of_each(rows):
    """Texts that stay, by a search over rows: linked groups keep the row of the smallest id, null last."""
    numbered = [(k, t) for k, (_, t, _) in enumerate(rows)]
    groups = collections.defaultdict(list)
    for k, n, root in plain_components(numbered):
        groups[root if n else (k,)].append(k)
    return [rows[min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))][:2] for g in groups.values()]


def test_near_duplicates_account_for_every_row(spark):
    """Rows without ids, repeated ids with equal and with other texts, blank texts, extra columns."""
    table = cases(spark, ODD)
    got = corpus_pipeline.near_duplicates(spark, table, "")
    assert got.columns == table.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = plain_one_of_each(ODD)
    assert sorted([i for i, _ in kept], key=repr) == sorted([i for i, _ in want], key=repr)
    assert sorted({t for _, t in kept} - {None}) == sorted({t for _, t in want} - {None})


@pytest.mark.parametrize("rows", [None, ODD, []], ids=["cases", "odd", "empty"])
def test_every_stage_takes_odd_rows(spark, rows, tmp_path):
    docs = cases(spark, rows)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates" and rows is ODD:
            assert docs.where("doc_id IS NULL").count() == 3 and docs.count() < before
    if rows == []:
        assert docs.count() == 0


def test_rows_of_a_large_group_grow_with_it(spark, monkeypatch):
    """Near copies of one text, twice as many: what the searches write grows by little more than two."""
    written = collections.Counter()

    def made(n):
        base = [f"v{i}" for i in range(120)]
        rows = []
        for i in range(n):
            w = list(base)
            for k in range(3):
                w[(i * 7 + k * 41) % 120] = f"e{i}_{k}"
            rows.append((i, " ".join(w), "s"))
        return cases(spark, rows).repartition(6)

    keep = ngram_jaccard.Scratch.keep

    def counted(self, df, by=None):
        out = keep(self, df, by)
        written[size] += out.count()
        return out

    monkeypatch.setattr(ngram_jaccard.Scratch, "keep", counted)
    for size in (700, 1400):
        ngram_jaccard.jaccard_components(made(size)).count()
    assert written[1400] <= 2.2 * written[700]
