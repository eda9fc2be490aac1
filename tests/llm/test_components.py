import random
from pathlib import Path
from types import SimpleNamespace

import pytest

from tidemark.llm.components import _large_star, components
from tidemark.llm.scratch import Scratch, shared_dir


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


CASES = {
    "none": [],
    "loops": [(1, 1), (2, 2)],
    "path": [(i, i + 1) for i in range(-20, 40)],
    "star": [(7, i) for i in range(60)] + [(7, 3), (3, 7)],
    "zigzag": [(1, 3), (2, 4), (3, 4), (10, 9), (9, 10)],
    "random": [(random.Random(i).randrange(300), random.Random(-i).randrange(300)) for i in range(1, 160)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    df = spark.createDataFrame(CASES[name], "u long, v long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "test")).collect()}
    assert {k: got.get(k, k) for k in plain(CASES[name])} == plain(CASES[name])
    assert all(v <= k for k, v in got.items())


def test_the_shared_folder_is_the_sessions():
    session = SimpleNamespace(conf={"spark.checkpoint.dir": "store://x/shared/"})
    assert shared_dir(session) == "store://x/shared"
    unset = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getConf=dict, master="local[2]"))
    assert shared_dir(unset).startswith("file:///tmp/checkpoints/")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getConf=dict, master="spark://x:7077")))


def test_kept_tables_can_be_dropped(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.range(3))
    folder = Path(scratch.root.removeprefix("file://"))
    assert kept.count() == 3 and list(folder.rglob("*.parquet"))
    scratch.drop(kept)
    assert not list(folder.rglob("*.parquet"))


def test_edges_of_a_hub_can_be_split(spark):
    """Nine tenths of the edges have one end in common: the join with the minima is a skew join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(400_000).selectExpr("IF(id % 10 = 0, id, 5) AS u", "id + 1000000 AS v").repartition(24)
        scratch = Scratch(spark, "hub")
        star = _large_star(scratch.keep(edges), scratch)
        assert "skew=true" in _plan_after_run(star)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _plan_after_run(df):
    df.toArrow()
    return df._jdf.queryExecution().executedPlan().toString()
