"""Aggregates, pivots, arrays and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import count_where, cut_round, euros, month_of, months_apart, qualify, rate, ratio, sum_where
from tidemark.operators.registry import query
from tidemark.operators.relational import DONE, PAID, _doctor_revenue, _spine
from tidemark.plans.models import Models


def _month(column: str = "appointment_date"):
    return month_of(column).alias("month")


@query
def countif_monthly(m: Models) -> DataFrame:
    return m.fct_appointments.groupBy(_month()).agg(F.count("*").alias("total"), *(count_where(F.col("status") == s).alias(s) for s in ("completed", "cancelled", "no_show", "scheduled")))


@query
def multi_count_distinct(m: Models) -> DataFrame:
    return m.fct_appointments.groupBy("channel").agg(F.count_distinct("patient_id").alias("patients"), F.count_distinct("doctor_id").alias("doctors"), F.count_distinct(month_of("appointment_date")).alias("months"), F.count_distinct("specialty_id").alias("specialties"))


@query
def conditional_sum(m: Models) -> DataFrame:
    state = F.col("payment_status")
    return m.fct_payments.groupBy("country_id").agg(*(sum_where(state == s, F.col("amount_cents")).alias(f"{s}_cents") for s in ("paid", "refunded", "failed")))


@query
def two_level_agg(m: Models) -> DataFrame:
    """Average and maximum over patients of their counts."""
    per = m.fct_appointments.groupBy("patient_id", "channel").agg(F.count("*").alias("n"))
    return per.groupBy("channel").agg(F.count("*").alias("patients"), cut_round(F.avg("n"), 4).alias("mean_visits"), F.max("n").alias("most_visits"))


@query
def share_of_group_join(m: Models) -> DataFrame:
    """A doctor's share of the specialty's completed visits."""
    by = m.fct_appointments.groupBy("doctor_id", "specialty_id").agg(count_where(F.col("status") == "completed").alias("doc_completed"))
    total = m.fct_appointments.groupBy("specialty_id").agg(count_where(F.col("status") == "completed").alias("spec_completed"))
    return by.join(total, "specialty_id").withColumn("share", ratio(F.col("doc_completed"), F.col("spec_completed")))


@query
def pivot_channel_revenue(m: Models) -> DataFrame:
    rows = m.fct_appointments.where(PAID).groupBy(_month()).pivot("channel", ["web", "app", "phone", "clinic"]).agg(F.sum("amount_cents"))
    return rows.select("month", *(F.coalesce(c, F.lit(0)).alias(f"{c}_cents") for c in ("web", "app", "phone", "clinic")))


@query
def pivot_cohort_m0_m6(m: Models) -> DataFrame:
    at = F.col("months_since_acquisition")
    return m.mart_patient_retention.groupBy("cohort_month", "cohort_size").agg(
        F.max(F.when(at == 0, F.col("retained_patients"))).alias("m0"), *(F.max(F.when(at == k, F.col("retention_rate"))).alias(f"ret_m{k}") for k in range(1, 7))
    )


@query
def array_agg_struct(m: Models) -> DataFrame:
    """Each patient's visits in order as an array of structs, and what it says when flattened."""
    visits = F.array_sort(F.collect_list(F.struct("appointment_date", "appointment_id", "status")))
    rows = m.fct_appointments.groupBy("patient_id").agg(visits.alias("v"))
    return rows.select("patient_id", F.size("v").cast("long").alias("visits"), F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["appointment_date"].cast("string"), x["status"])), ",").alias("history"))


@query
def string_agg_distinct(m: Models) -> DataFrame:
    by = m.fct_appointments.groupBy("doctor_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), F.count_distinct("channel").alias("n"))
    return by.where("n >= 2")


@query
def approx_distinct(m: Models) -> DataFrame:
    """Whether the sketch's count is within 6 percent of the exact one."""
    # Beside a distinct count, Spark would keep a sketch for each pair, not for each status.
    pairs = m.fct_appointments.select("status", "patient_id").distinct()
    by = pairs.groupBy("status").agg(F.approx_count_distinct("patient_id", 0.01).alias("a"), F.count("patient_id").alias("patients"))
    return by.select("status", "patients", (F.abs(F.col("a") - F.col("patients")) <= 0.06 * F.col("patients") + 1).alias("close"))


@query
def quantiles_exact(m: Models) -> DataFrame:
    parts = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY amount_cents)").cast("long").alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return m.fct_payments.groupBy("payment_status").agg(F.min("amount_cents").alias("least"), *parts, F.max("amount_cents").alias("most"))


@query
def quantiles_approx(m: Models) -> DataFrame:
    """Five approximate quartiles as an array: the ends are exact, the middle within 2 percent of the exact ones."""
    places = (0.0, 0.25, 0.5, 0.75, 1.0)
    q = F.percentile_approx("amount_cents", F.array(*map(F.lit, places)), F.lit(10000))
    exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY amount_cents)").alias(f"e{i}") for i, p in enumerate(places)]
    rows = m.fct_payments.groupBy("payment_status").agg(q.alias("q"), *exact)
    close = [(F.abs(F.get("q", F.lit(i)) - F.col(f"e{i}")) <= F.col(f"e{i}") * 0.02).alias(n) for i, n in ((1, "q1_close"), (2, "median_close"), (3, "q3_close"))]
    return rows.select("payment_status", F.get("q", F.lit(0)).alias("least"), *close, F.get("q", F.lit(4)).alias("most"))


@query
def null_audit(m: Models) -> DataFrame:
    columns = ("doctor_id", "cancellation_reason", "amount_cents", "days_since_last_appointment", "specialty_id")
    return m.fct_appointments.agg(F.count("*").alias("n_rows"), *(count_where(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


@query
def rounded_bucket(m: Models) -> DataFrame:
    rows = m.mart_appointment_quality.where("avg_doctor_rating IS NOT NULL").groupBy(cut_round(F.col("avg_doctor_rating"), 1).alias("rating_bucket")).agg(F.sum("total_appointments").alias("total_appointments"), F.sum("no_show").alias("no_shows"))
    return rows.withColumn("no_show_rate", rate(F.col("no_shows"), F.col("total_appointments")))


@query
def global_stats(m: Models) -> DataFrame:
    return m.fct_appointments.agg(F.count("*").alias("n_rows"), F.count("amount_cents").alias("with_amount"), F.min("appointment_date").alias("first_date"), F.max("appointment_date").alias("last_date"), F.sum("amount_cents").alias("cents"), cut_round(F.avg("patient_age_at_appointment"), 4).alias("mean_age"))


@query
def having_volume(m: Models) -> DataFrame:
    """Combinations with ten visits or more and the 30 worst of them by a total order."""
    by = m.fct_appointments.groupBy("channel", "specialty_id", "country_id").agg(F.count("*").alias("total_appointments"), count_where(F.col("status") == "no_show").alias("no_shows")).where("total_appointments >= 10")
    return by.withColumn("no_show_rate", rate(F.col("no_shows"), F.col("total_appointments"))).orderBy(F.desc("no_show_rate"), F.desc("total_appointments"), "channel", "specialty_id", "country_id").limit(30)


# Windows. Every order ends in a key, so ties have one result.



def _visits() -> WindowSpec:
    return Window.partitionBy("patient_id").orderBy("appointment_start_at", "appointment_id")


@query
def win_row_number(m: Models) -> DataFrame:
    return m.fct_appointments.select("appointment_id", "patient_id", F.row_number().over(_visits()).cast("long").alias("visit_number"))


@query
def win_rank_variants(m: Models) -> DataFrame:
    by = m.fct_appointments.groupBy("specialty_id", "doctor_id").agg(F.count("*").alias("visits"))
    w = Window.partitionBy("specialty_id").orderBy(F.desc("visits"))
    return by.select("*", F.rank().over(w).cast("long").alias("rank_gaps"), F.dense_rank().over(w).cast("long").alias("rank_dense"), F.row_number().over(w.orderBy(F.desc("visits"), "doctor_id")).cast("long").alias("rank_row"))


@query
def win_ntile(m: Models) -> DataFrame:
    """Quartiles of doctors by visits within their country."""
    by = m.fct_appointments.where("country_id IS NOT NULL").groupBy("country_id", "doctor_id").agg(F.count("*").alias("visits"))
    return by.withColumn("quartile", F.ntile(4).over(Window.partitionBy("country_id").orderBy(F.desc("visits"), "doctor_id")).cast("long"))


@query
def win_lag_days(m: Models) -> DataFrame:
    before = F.lag("appointment_date", 1).over(_visits())
    return m.fct_appointments.select("appointment_id", before.alias("previous_date"), F.datediff("appointment_date", before).cast("long").alias("days"))


@query
def win_lead(m: Models) -> DataFrame:
    return m.fct_appointments.select("appointment_id", F.lead("appointment_date").over(_visits()).alias("next_date"), F.lead("status", 1, "none").over(_visits()).alias("next_status"))


@query
def win_first_last(m: Models) -> DataFrame:
    whole = _visits().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return m.fct_appointments.select("patient_id", F.first("channel").over(whole).alias("first_channel"), F.last("channel").over(whole).alias("last_channel")).distinct()


@query
def win_running_rolling(m: Models) -> DataFrame:
    by = m.fct_payments.where(PAID).groupBy("payment_date").agg(F.sum("amount_cents").alias("cents"))
    w = Window.orderBy("payment_date")  # one row a day
    return by.select("payment_date", "cents", F.sum("cents").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.sum("cents").over(w.rowsBetween(-6, 0)).alias("rolling_7"))


@query
def win_rolling_avg_spine(m: Models) -> DataFrame:
    """A seven-day mean over all days, those without visits as zero."""
    visits = m.fct_appointments.groupBy(F.col("appointment_date").alias("date")).agg(F.count("*").alias("visits"))
    days = _spine(m.fct_appointments, "appointment_date", "1 DAY").join(visits, "date", "left").na.fill(0)
    return days.withColumn("mean_7", cut_round(F.avg("visits").over(Window.orderBy("date").rowsBetween(-6, 0)), 4))


@query
def qualify_latest(m: Models) -> DataFrame:
    """The last completed visit of each patient: filtered first, one row each."""
    w = Window.partitionBy("patient_id").orderBy(F.desc("appointment_start_at"), F.desc("appointment_id"))
    return qualify(m.fct_appointments.where(DONE), F.row_number().over(w), lambda r: r == 1).select("patient_id", "appointment_id", "appointment_date")


@query
def qualify_top_per_group(m: Models) -> DataFrame:
    w = Window.partitionBy("specialty_id").orderBy(F.desc("cents"))
    return qualify(_doctor_revenue(m), F.rank().over(w), lambda r: r == 1)


@query
def qualify_nth(m: Models) -> DataFrame:
    """The second most visited doctors of each country, ties included."""
    by = m.fct_appointments.where(DONE).groupBy("country_id", "doctor_id").agg(F.count("*").alias("total_appointments"))
    return qualify(by, F.dense_rank().over(Window.partitionBy("country_id").orderBy(F.desc("total_appointments"))), lambda r: r == 2)


@query
def qualify_pk_duplicates(m: Models) -> DataFrame:
    """Lines whose supposed key occurs again."""
    lines = m.raw.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return qualify(lines, F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber")), lambda n: n > 1)


@query
def share_of_total(m: Models) -> DataFrame:
    by = m.fct_appointments.groupBy("channel").agg(F.count("*").alias("appointments"))
    total = F.sum("appointments").over(Window.partitionBy())  # one row a channel
    return by.withColumns({"total_appointments": total, "pct_of_total": cut_round(ratio(F.col("appointments") * 100, total), 2)})


@query
def worst_channel(m: Models) -> DataFrame:
    by = m.fct_appointments.groupBy("specialty_id", "channel").agg(F.count("*").alias("total_appointments"), count_where(F.col("status") == "no_show").alias("no_shows")).where("total_appointments >= 10")
    by = by.withColumn("no_show_rate", rate(F.col("no_shows"), F.col("total_appointments")))
    return qualify(by, F.rank().over(Window.partitionBy("specialty_id").orderBy(F.desc("no_show_rate"))), lambda r: r == 1)


@query
def win_default_frame(m: Models) -> DataFrame:
    """Running visits of a patient by day in the default frame, which takes all rows of equal order."""
    w = Window.partitionBy("patient_id").orderBy("appointment_date")
    return m.fct_appointments.select("appointment_id", "patient_id", "appointment_date", F.count("*").over(w).alias("visits_so_far"), F.last("appointment_date").over(w).alias("last_date"))


@query
def having_global(m: Models) -> DataFrame:
    """One row if there are any missing payments, else none."""
    return m.fct_appointments.agg(F.count("*").alias("n_rows"), count_where(F.col("is_missing_payment")).alias("missing_payments")).where("missing_payments > 0")


@query
def distinct_supply_cells(m: Models) -> DataFrame:
    return m.dim_doctors.select("specialty_id", "country_id", "is_active").distinct()
