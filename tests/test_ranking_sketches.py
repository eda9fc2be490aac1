"""Distributed places, and sketches that are stored and merged."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sketches
from tidemark.operators.ranking import tile, with_places
from tidemark.plans.models import Models
from tidemark.storage import keep


@pytest.mark.parametrize("n", [0, 1, 3, 7, 1000])
def test_places_and_tiles(spark, n):
    """Nine tenths of the values are null: places follow the order of all rows, tiles are those of NTILE."""
    rng = random.Random(n)
    rows = [(i, None if rng.random() < 0.9 else rng.randrange(5)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    got = with_places(df, [F.desc_nulls_last("v"), F.asc("id")], ranges=6).withColumn("t", tile(F.col("place"), F.col("total"), 5)).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [i for i, _ in want]
    size, extra = divmod(n, 5)
    tiles = [t + 1 for t in range(5) for _ in range(size + (t < extra))]
    assert [r["t"] for r in sorted(got, key=lambda r: r["place"])] == tiles
    assert {r["total"] for r in got} <= {n}


def test_equal_values_lie_in_several_ranges(spark):
    """No task holds all rows: those without a value are dealt by the last column of the order."""
    df = spark.range(20_000).select("id", F.lit(None).cast("long").alias("v"))
    dealt = df.repartitionByRange(8, F.desc_nulls_last("v"), F.asc("id")).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 5000


def test_one_task_sees_one_row_a_range(spark):
    out = with_places(spark.range(5000).toDF("id"), [F.asc("id")], ranges=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") <= 2
    sizes = out.select("total").distinct().collect()
    assert [r[0] for r in sizes] == [5000]
    above = plan.split("Exchange SinglePartition")[1]
    assert "HashAggregate" in above.split("FileScan")[0]  # what meets in one task are the sizes of ranges


@pytest.fixture(scope="module")
def m(spark, small):
    return Models(spark, small)


def test_spans_read_the_sketches_only(m):
    for make, span in ((sketches.visit_days, sketches.patients_by_span), (sketches.payment_days, sketches.amounts_by_span)):
        plan = span(keep(make(m), "days"))._jdf.queryExecution().optimizedPlan().toString()
        assert "orders" not in plan and "patient_id" not in plan and "amount_cents" not in plan
        assert "Join" not in plan


def test_sketches_merge_like_one_of_all(spark):
    """Days in any grouping: merged sketches of many values stay within the bound."""
    rows = spark.range(60_000).selectExpr("date_add(DATE'2024-01-01', CAST(id % 90 AS INT)) AS date", "id * 7919 % 20011 AS patient_id", "id * 31 % 50021 AS amount_cents")
    days = keep(rows.groupBy("date").agg(F.hll_sketch_agg("patient_id", F.lit(sketches.HLL_LG_K)).alias("patients"), F.kll_sketch_agg_bigint("amount_cents", F.lit(sketches.KLL_K)).alias("amounts")), "days")
    whole = sketches.patients_by_span(days).where("month IS NULL").first()["estimate"]
    assert abs(whole - 20011) <= 0.05 * 20011
    row = sketches.amounts_by_span(days).where("month IS NULL").first()
    ranks = rows.agg(*(F.avg((F.col("amount_cents") <= row[c]).cast("int")) for c in ("q1", "median", "q3"))).first()
    assert row["n"] == 60_000 and all(abs(a - b) <= 0.02 for a, b in zip(ranks, (0.25, 0.5, 0.75), strict=True))


def test_retention_of_large_sets(spark):
    """Cohorts far beyond the sketch's size."""
    people = spark.range(90_000).selectExpr("id AS patient_id", "add_months(DATE'2024-01-01', CAST(id % 3 AS INT)) AS month")
    seen = people.selectExpr("patient_id", "explode(sequence(month, DATE'2024-04-01', INTERVAL 1 MONTH)) AS month").where("patient_id % 5 <> month(month)")
    theta = F.theta_sketch_agg("patient_id", F.lit(sketches.THETA_LG_K)).alias("set")
    got = sketches.retention_of_sets(people.groupBy("month").agg(theta), seen.groupBy("month").agg(theta)).collect()
    assert len(got) == 4 + 3 + 2
    for r in got:
        month = r["cohort_month"].month + r["months_since_acquisition"]
        want = 24_000 if month < 5 else 30_000
        assert abs(r["retained"] - want) <= 0.05 * 30_000 and abs(r["cohort"] - 30_000) <= 0.05 * 30_000


def test_retention_of_a_small_cohort_in_large_months(spark):
    """A hundred patients among months of sixty thousand: as exact as large cohorts are."""
    patients = spark.range(60_100).selectExpr("id AS patient_id", "IF(id < 60000, DATE'2024-01-01', DATE'2024-02-01') AS cohort_month")
    visits = patients.selectExpr("patient_id", "explode(sequence(cohort_month, DATE'2024-04-01', INTERVAL 1 MONTH)) AS appointment_date", "'completed' AS status")
    sets = sketches.retention_sets(SimpleNamespace(int_patient_lifetime_metrics=patients, fct_appointments=visits.where("patient_id % 2 = 0 OR month(appointment_date) < 4")))
    got = {(r["cohort_month"].month, r["months_since_acquisition"]): r["retained"] for r in sketches.retention_of_sets(*sets).collect()}
    assert len(got) == 4 + 3
    for (month, since), n in got.items():
        size = 60_000 if month == 1 else 100
        assert abs(n - (size if month + since < 4 else size / 2)) <= 0.05 * size + 1


def test_a_sketch_for_each_status_only(m):
    """No aggregate keeps a sketch for each pair of status and patient."""
    from tidemark.operators.aggregates import approx_distinct

    plan = approx_distinct(m)._jdf.queryExecution().executedPlan().toString()
    sketched = [line for line in plan.splitlines() if "approx_count_distinct" in line and "keys=" in line]
    assert sketched and not [line for line in sketched if "patient_id" in line.split("keys=")[1].split("]")[0]]


def test_leads_without_a_visit_do_not_meet_in_one_task(spark, small):
    session = spark.newSession()
    for k, v in {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.session.timeZone": "UTC"}.items():
        session.conf.set(k, v)
    leads = Models(session, small).fct_leads
    sizes = [r["count"] for r in leads.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < sum(sizes) / 4
