"""Queries on stored sketches: of each day or group one small row, merged to months, to all time, or as sets.

The sketches of a day are written once; a later question about any span of days merges rows of that table and never reads
the facts. Each query stands beside its exact twin and reports whether the sketch is within its error bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import month_of, months_apart
from tidemark.operators.registry import query
from tidemark.operators.relational import DONE, PAID
from tidemark.plans.models import Models
from tidemark.storage import keep

#: Size of the sketches, and how far they may be off: of counts in parts of the count, of quantiles in ranks.
HLL_LG_K, KLL_K, THETA_LG_K = 13, 400, 13
COUNT_ERROR, RANK_ERROR = 0.05, 0.02
_QUARTERS = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def visit_days(m: Models) -> DataFrame:
    """(date, patients): by day a sketch of who came."""
    return m.fct_appointments.groupBy(F.col("appointment_date").alias("date")).agg(F.hll_sketch_agg("patient_id", F.lit(HLL_LG_K)).alias("patients"))


def payment_days(m: Models) -> DataFrame:
    """(date, amounts): by day a sketch of what was paid."""
    return m.fct_payments.where(PAID).groupBy(F.col("payment_date").alias("date")).agg(F.kll_sketch_agg_bigint("amount_cents", F.lit(KLL_K)).alias("amounts"))


def _months_and_all(days: DataFrame, *merged: Column) -> DataFrame:
    """Sketches of days merged by month, and all of them under a null month."""
    by = days.groupBy(month_of("date").alias("month")).agg(*merged)
    return by.unionByName(days.agg(*merged).withColumn("month", F.lit(None).cast("date")))


def _close(estimate: Column, exact: Column) -> Column:
    return F.abs(estimate - exact) <= COUNT_ERROR * exact + 1


def patients_by_span(days: DataFrame) -> DataFrame:
    return _months_and_all(days, F.hll_union_agg("patients").alias("s")).select("month", F.hll_sketch_estimate("s").alias("estimate"))


def amounts_by_span(days: DataFrame) -> DataFrame:
    out = _months_and_all(days, F.kll_merge_agg_bigint("amounts").alias("s"))
    return out.select("month", F.kll_sketch_get_n_bigint("s").alias("n"), *(F.kll_sketch_get_quantile_bigint("s", F.lit(p)).alias(name) for name, p in _QUARTERS))


@query
def sketched_patients(m: Models) -> DataFrame:
    """Patients by month and in all (null month) from sketches of days, within 5 percent of the exact count."""
    visits = m.fct_appointments.select(month_of("appointment_date").alias("month"), "patient_id")
    exact = visits.groupBy("month").agg(F.count_distinct("patient_id").alias("patients"))
    exact = exact.unionByName(visits.agg(F.count_distinct("patient_id").alias("patients")).withColumn("month", F.lit(None).cast("date")))
    merged = patients_by_span(keep(visit_days(m), "visit_days"))
    return exact.join(merged.withColumnRenamed("month", "_m"), F.col("month").eqNullSafe(F.col("_m"))).select("month", "patients", _close(F.col("estimate"), F.col("patients")).alias("close"))


@query
def sketched_amounts(m: Models) -> DataFrame:
    """Quartiles of payments by month and in all (null month) from sketches of days, within 2 percent of the ranks."""

    def bounds(by: DataFrame) -> list[Column]:
        at = lambda p: F.expr(f"percentile_disc({min(1.0, max(0.0, p))}) WITHIN GROUP (ORDER BY amount_cents)")
        return [F.count("*").alias("payments"), *(c for name, p in _QUARTERS for c in (at(p - RANK_ERROR).alias(f"{name}_low"), at(p + RANK_ERROR).alias(f"{name}_high")))]

    paid = m.fct_payments.where(PAID).select(month_of("payment_date").alias("month"), "amount_cents")
    exact = paid.groupBy("month").agg(*bounds(paid)).unionByName(paid.agg(*bounds(paid)).withColumn("month", F.lit(None).cast("date")))
    merged = amounts_by_span(keep(payment_days(m), "payment_days")).withColumnRenamed("month", "_m")
    within = [F.col(name).between(F.col(f"{name}_low"), F.col(f"{name}_high")).alias(f"{name}_close") for name, _ in _QUARTERS]
    return exact.join(merged, F.col("month").eqNullSafe(F.col("_m"))).select("month", "payments", (F.col("n") == F.col("payments")).alias("n_equal"), *within)


def retention_sets(m: Models) -> tuple[DataFrame, DataFrame]:
    """(month, set) of the patients of a cohort, and (cohort_month, month, set) of those of a cohort active in a month.

    A month's patients of all cohorts in one set would be sampled too thinly to tell how many of a small cohort are among
    them: an intersection holds no more of either set than the larger one was sampled at.
    """
    theta = F.theta_sketch_agg("patient_id", F.lit(THETA_LG_K)).alias("set")
    patients = m.int_patient_lifetime_metrics.where("cohort_month IS NOT NULL").select("patient_id", "cohort_month")
    cohorts = patients.groupBy(F.col("cohort_month").alias("month")).agg(theta)
    active = m.fct_appointments.where(DONE).select("patient_id", month_of("appointment_date").alias("month"))
    return cohorts, active.join(patients, "patient_id").groupBy("cohort_month", "month").agg(theta)


def retention_of_sets(cohorts: DataFrame, active: DataFrame) -> DataFrame:
    """(cohort_month, months_since_acquisition, retained, cohort) as estimates, from one row a month on either side, or a row a cohort and month."""
    last = active.agg(F.max("month").alias("last"))
    pairs = cohorts.crossJoin(F.broadcast(last)).where("month <= last")  # one row
    pairs = pairs.select(F.col("month").alias("cohort_month"), F.col("set").alias("cohort_set"), F.explode(F.sequence("month", "last", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    rows = pairs.join(active, [c for c in ("cohort_month", "month") if c in active.columns]).withColumn("both", F.theta_intersection("cohort_set", "set"))
    return rows.select("cohort_month", months_apart("month", "cohort_month").alias("months_since_acquisition"), F.theta_sketch_estimate("both").alias("retained"), F.theta_sketch_estimate("cohort_set").alias("cohort"))


@query
def sketched_retention(m: Models) -> DataFrame:
    """The retention mart from set sketches alone, each count within 5 percent of its cohort."""
    cohorts, active = (keep(x, "retention_sets") for x in retention_sets(m))
    sets = retention_of_sets(cohorts, active)
    rows = m.mart_patient_retention.join(sets, ["cohort_month", "months_since_acquisition"], "left")
    near = F.abs(F.col("retained") - F.col("retained_patients")) <= COUNT_ERROR * F.col("cohort_size") + 1
    return rows.select("cohort_month", "months_since_acquisition", "retained_patients", F.coalesce(near, F.lit(False)).alias("close"))


def channel_sets(m: Models) -> DataFrame:
    return m.fct_appointments.where(DONE).groupBy("channel").agg(F.theta_sketch_agg("patient_id", F.lit(THETA_LG_K)).alias("set"))


@query
def channel_overlap(m: Models) -> DataFrame:
    """Patients of each channel who also came, or never came, by the web: set sketches beside exact counts."""
    sets = keep(channel_sets(m), "channel_sets")
    web = sets.where("channel = 'web'").select(F.col("set").alias("web"))
    estimates = sets.crossJoin(F.broadcast(web)).select(  # one row
        "channel", F.theta_sketch_estimate(F.theta_intersection("set", "web")).alias("both"), F.theta_sketch_estimate(F.theta_difference("set", "web")).alias("only")
    )
    visits = m.fct_appointments.where(DONE).select("channel", "patient_id").distinct()
    by_web = visits.where("channel = 'web'").select("patient_id", F.lit(True).alias("on_web"))
    exact = visits.join(by_web, "patient_id", "left").groupBy("channel").agg(F.count("*").alias("patients"), F.count("on_web").alias("also_web"))
    rows = exact.join(estimates, "channel")
    return rows.select("channel", "patients", "also_web", (F.abs(F.col("both") - F.col("also_web")) <= COUNT_ERROR * F.col("patients") + 1).alias("both_close"), (F.abs(F.col("only") - (F.col("patients") - F.col("also_web"))) <= COUNT_ERROR * F.col("patients") + 1).alias("only_close"))


@query
def phone_not_web(m: Models) -> DataFrame:
    """Patients with completed visits by phone and none by the web."""
    done = m.fct_appointments.where(DONE)
    return done.where("channel = 'phone'").select("patient_id").subtract(done.where("channel = 'web'").select("patient_id"))
