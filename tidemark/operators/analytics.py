"""Analytical queries: growth, funnels, lifetime value, retention, capacity; and the dashboards' measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import count_where, cut_round, euros, euros_each, month_of, months_apart, pct_growth, rate, ratio, sum_where
from tidemark.operators.ranking import tile, with_places
from tidemark.operators.registry import query
from tidemark.operators.relational import DONE, PAID, _next_visit
from tidemark.plans.models import Models


def _paid_by_month(m: Models) -> DataFrame:
    return m.fct_payments.where(PAID).groupBy(month_of("payment_date").alias("month")).agg(F.sum("amount_cents").alias("cents"))


@query
def mom_yoy_cumulative(m: Models) -> DataFrame:
    w = Window.orderBy("month")  # one row a month
    prev, year_ago, now = F.lag("cents", 1).over(w), F.lag("cents", 12).over(w), F.col("cents")
    return _paid_by_month(m).select(
        "month", euros(now).alias("revenue_eur"), euros(prev).alias("prev_month_revenue"), euros(year_ago).alias("same_month_last_year"), cut_round(pct_growth(now, prev), 6).alias("mom_growth"),
        cut_round(pct_growth(now, year_ago), 6).alias("yoy_growth"), euros(F.sum(now).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative_revenue"),
    )


def _to_date(m: Models) -> DataFrame:
    last = m.fct_payments.where(PAID).agg(F.max("payment_date").alias("anchor"))
    return m.fct_payments.where(PAID).crossJoin(F.broadcast(last))  # one row


@query
def mtd_qtd_ytd(m: Models) -> DataFrame:
    def since(unit: str):
        return euros(sum_where(F.col("payment_date") >= F.trunc("anchor", unit), F.col("amount_cents")))

    return _to_date(m).agg(since("month").alias("revenue_mtd"), since("quarter").alias("revenue_qtd"), since("year").alias("revenue_ytd"), euros(F.sum("amount_cents")).alias("revenue_all_time"))


@query
def channel_rates(m: Models) -> DataFrame:
    by = m.fct_appointments.groupBy(month_of("appointment_date").alias("month"), "channel").agg(F.count("*").alias("total_appointments"), *(count_where(F.col("status") == s).alias(s) for s in ("completed", "no_show", "cancelled")))
    return by.withColumns({f"{s}_rate": rate(F.col(s), F.col("total_appointments")) for s in ("completed", "no_show", "cancelled")})


@query
def ltv(m: Models) -> DataFrame:
    """Value per patient, with quintiles of one order of all patients (see ranking)."""
    paid = m.fct_payments.where(PAID).select("appointment_id", F.col("amount_cents").alias("paid_cents"))
    by = m.fct_appointments.where(DONE).select("appointment_id", "patient_id", "appointment_date").join(paid, "appointment_id", "left").groupBy("patient_id").agg(
        F.sum("paid_cents").alias("cents"), F.count_distinct("appointment_id").alias("total_appointments"), months_apart(F.max("appointment_date"), F.min("appointment_date")).alias("lifespan_months")
    )
    by = by.select(
        "patient_id", "cents", euros("cents").alias("ltv_eur"), "total_appointments", "lifespan_months", euros_each(F.col("cents"), F.col("total_appointments")).alias("avg_revenue_per_visit"),
        cut_round(ratio(F.col("total_appointments"), F.nullif("lifespan_months", F.lit(0))), 2).alias("visits_per_month"),
    )
    rows = with_places(by, [F.desc_nulls_last("cents"), F.asc("patient_id")])
    return rows.withColumn("ltv_quintile", tile(F.col("place"), F.col("total"), 5)).drop("cents", "place", "total")


@query
def stage_funnel(m: Models) -> DataFrame:
    """Leads and conversions by lead month, payments by their own month."""
    leads = m.fct_leads.groupBy(month_of("lead_date").alias("month")).agg(F.count("*").alias("total_leads"), count_where(F.col("is_converted_to_appointment")).alias("converted_leads"))
    paid = m.fct_payments.where(PAID).groupBy(month_of("payment_date").alias("month")).agg(F.count("*").alias("paid_appointments"))
    rows = leads.join(paid, "month", "left")
    known = F.nullif("converted_leads", F.lit(0))
    return rows.select(
        "month", "total_leads", "converted_leads", F.coalesce("paid_appointments", F.lit(0)).alias("paid_appointments"), rate(known, F.col("total_leads")).alias("lead_conversion_rate"),
        rate(F.col("paid_appointments"), known).alias("appt_to_payment_rate"), rate(F.col("paid_appointments"), F.col("total_leads")).alias("end_to_end_rate"),
    )


@query
def utilisation(m: Models) -> DataFrame:
    rows = m.fct_appointments.drop("specialty_id").join(m.dim_doctors.select("doctor_id", "specialty_id"), "doctor_id")
    by = rows.groupBy(month_of("appointment_date").alias("month"), "specialty_id").agg(F.count_distinct("doctor_id").alias("active_doctors"), F.count("*").alias("total_slots"), count_where(F.col("status") == "completed").alias("completed_slots"))
    return by.withColumns({"utilisation_rate": rate(F.col("completed_slots"), F.col("total_slots")), "avg_appointments_per_doctor": cut_round(ratio(F.col("total_slots"), F.col("active_doctors")), 1)})


@query
def supply_demand_active(m: Models) -> DataFrame:
    demand = m.fct_appointments.groupBy(month_of("appointment_date").alias("month"), "specialty_id", "country_id").agg(F.count("*").alias("appointments_requested"), F.count_distinct("patient_id").alias("unique_patients"))
    supply = m.dim_doctors.where("is_active").groupBy("specialty_id", "country_id").agg(F.count_distinct("doctor_id").alias("active_doctors"))
    return demand.join(supply, ["specialty_id", "country_id"]).withColumn("demand_per_doctor", cut_round(ratio(F.col("appointments_requested"), F.col("active_doctors")), 1))


@query
def funnel_by_source(m: Models) -> DataFrame:
    """Complete months only: those before the last lead's."""
    last = m.fct_leads.agg(month_of(F.max("lead_date")).alias("_open"))
    rows = m.fct_leads.crossJoin(F.broadcast(last)).where(F.col("lead_date") < F.col("_open"))  # one row
    by = rows.groupBy(month_of("lead_date").alias("lead_month"), "lead_source").agg(F.count_distinct("lead_id").alias("total_leads"), count_where(F.col("is_converted_to_appointment")).alias("to_appointment"), count_where(F.col("is_converted_to_payment")).alias("to_payment"))
    return by.withColumns({"lead_to_appt_rate": rate(F.col("to_appointment"), F.col("total_leads")), "appt_to_payment_rate": rate(F.col("to_payment"), F.col("to_appointment")), "end_to_end_rate": rate(F.col("to_payment"), F.col("total_leads"))})


@query
def return_90d(m: Models) -> DataFrame:
    soon = F.datediff("second_date", "first_date") <= 90
    by = _next_visit(m).groupBy(month_of("first_date").alias("acquisition_month")).agg(F.count("*").alias("new_patients"), count_where(soon).alias("returned_in_90d"))
    return by.withColumn("return_rate", rate(F.col("returned_in_90d"), F.col("new_patients")))


@query
def recency_segments(m: Models) -> DataFrame:
    last = m.fct_appointments.where(DONE).groupBy("patient_id").agg(F.max("appointment_date").alias("last_appointment_date"))
    rows = last.crossJoin(F.broadcast(m.fct_appointments.where(DONE).agg(F.max("appointment_date").alias("_anchor"))))  # one row
    days = F.datediff("_anchor", "last_appointment_date").cast("long")
    return rows.select("patient_id", "last_appointment_date", days.alias("days_since_last_visit"), F.when(days <= 90, "active").when(days <= 365, "at_risk").otherwise("churned").alias("patient_segment"))


@query
def segment_shares(m: Models) -> DataFrame:
    by = recency_segments(m).groupBy("patient_segment").agg(F.count("*").alias("patients"))
    return by.withColumn("pct_of_total", cut_round(ratio(F.col("patients"), F.sum("patients").over(Window.partitionBy())), 6))


@query
def cohort_retention_adhoc(m: Models) -> DataFrame:
    """Retention of the first five months in percent, a column a month."""
    at, pct = F.col("months_since_acquisition"), cut_round(F.col("retention_rate") * 100, 1)
    rows = m.mart_patient_retention.where("months_since_acquisition <= 5")
    return rows.groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort"), "cohort_size").agg(*(F.max(F.when(at == k, pct)).alias(f"m{k}_pct") for k in range(6)))


@query
def no_show_trend_3m(m: Models) -> DataFrame:
    by = m.fct_appointments.groupBy(month_of("appointment_date").alias("month")).agg(F.count("*").alias("total_appointments"), count_where(F.col("status") == "no_show").alias("no_shows"))
    r = ratio(F.col("no_shows"), F.col("total_appointments"))
    return by.withColumns({"no_show_rate": cut_round(r, 6), "no_show_rate_3m_avg": cut_round(F.avg(r).over(Window.orderBy("month").rowsBetween(-2, 0)), 6)})


@query
def booking_window(m: Models) -> DataFrame:
    days = F.datediff("appointment_date", F.to_date("appointment_created_at"))
    label = F.when(days == 0, "same_day").when(days <= 3, "1-3_days").when(days <= 7, "4-7_days").when(days <= 14, "8-14_days").otherwise("15+_days")
    by = m.fct_appointments.groupBy(label.alias("booking_window")).agg(F.count("*").alias("appointments"), count_where(F.col("status") == "no_show").alias("_no"))
    return by.withColumn("no_show_rate", rate(F.col("_no"), F.col("appointments"))).drop("_no")


@query
def mau(m: Models) -> DataFrame:
    return m.fct_appointments.where(DONE).groupBy(month_of("appointment_date").alias("month")).agg(F.count_distinct("patient_id").alias("active_patients"))


@query
def last12m_volume(m: Models) -> DataFrame:
    last = m.fct_appointments.agg(F.add_months(F.max("appointment_date"), -12).alias("_from"))
    rows = m.fct_appointments.crossJoin(F.broadcast(last)).where(F.col("appointment_date") >= F.col("_from"))  # one row
    by = rows.groupBy(month_of("appointment_date").alias("month"), "doctor_id").agg(F.count("*").alias("total_appointments"), count_where(F.col("status") == "completed").alias("completed"), count_where(F.col("status") == "no_show").alias("no_shows"))
    return by.withColumn("no_show_rate", rate(F.col("no_shows"), F.col("total_appointments")))


# Measures of the dashboards.


@query
def bi_revenue_mtd_mom(m: Models) -> DataFrame:
    day, start = F.col("payment_date"), F.trunc("anchor", "month")
    now = sum_where(day >= start, F.col("amount_cents"))
    before = sum_where((day < start) & (day >= F.add_months(start, -1)), F.col("amount_cents"))
    rows = _to_date(m).groupBy("anchor").agg(F.sum("amount_cents").alias("all"), now.alias("now"), before.alias("before"))
    growth = cut_round(pct_growth(F.col("now"), F.col("before")), 6)
    arrow = F.when(growth > 0, "up").when(growth < 0, "down").otherwise("flat")
    return rows.select(euros("all").alias("revenue_total"), euros("now").alias("revenue_mtd"), euros("before").alias("revenue_prev_month"), growth.alias("mom_pct"), arrow.alias("trend"))


@query
def bi_revenue_ytd_yoy(m: Models) -> DataFrame:
    day, start = F.col("payment_date"), F.trunc("anchor", "year")
    now = sum_where(day >= start, F.col("amount_cents"))
    before = sum_where((day >= F.add_months(start, -12)) & (day <= F.add_months("anchor", -12)), F.col("amount_cents"))
    rows = _to_date(m).groupBy("anchor").agg(now.alias("now"), before.alias("before"))
    return rows.select(euros("now").alias("revenue_ytd"), euros("before").alias("revenue_sply"), cut_round(pct_growth(F.col("now"), F.col("before")), 6).alias("yoy_pct"))


@query
def bi_weighted_rates(m: Models) -> DataFrame:
    """Rates as sums over sums by month, with the dashboards' colour bands."""
    rows = m.agg_daily_business_kpis.groupBy(month_of("date").alias("month")).agg(*(F.sum(c).alias(c) for c in ("total_appointments", "completed_appointments", "no_show_appointments", "new_patient_appointments", "total_leads", "converted_leads")))
    done = ratio(F.col("completed_appointments"), F.col("total_appointments"))
    return rows.select(
        "month", "total_appointments", "completed_appointments", F.col("new_patient_appointments").alias("new_patients"), rate(F.col("completed_appointments"), F.col("total_appointments")).alias("completion_rate"),
        rate(F.col("no_show_appointments"), F.col("total_appointments")).alias("no_show_rate"), rate(F.col("converted_leads"), F.col("total_leads")).alias("lead_conversion"),
        F.when(done >= 0.75, "green").when(done >= 0.6, "amber").otherwise("red").alias("completion_band"), F.concat(F.lit("Q"), F.quarter("month").cast("string")).alias("quarter_label"),
    )


@query
def bi_specialty_table(m: Models) -> DataFrame:
    rows = m.agg_specialty_performance.groupBy("specialty_name").agg(F.sum("total_appointments").alias("appointments"), F.sum("completed_appointments").alias("completed"), F.sum(F.round(F.col("total_revenue_eur") * 100).cast("long")).alias("cents"))
    demand = cut_round(ratio(F.col("appointments"), F.sum("appointments").over(Window.partitionBy())), 6)  # one row a specialty
    return rows.select("specialty_name", "appointments", "completed", euros("cents").alias("revenue_eur"), euros_each(F.col("cents"), F.col("completed")).alias("ticket_eur"), demand.alias("demand_share"))


@query
def bi_monthly_trend(m: Models) -> DataFrame:
    """Totals and the unweighted mean of daily rates, which is what the page shows."""
    return m.agg_daily_business_kpis.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.sum("total_appointments").alias("appointments"), F.max("cumulative_appointments").alias("cumulative"), cut_round(F.avg("completion_rate") * 100, 2).alias("mean_daily_completion_pct"), F.sum("total_leads").alias("leads")
    )


@query
def bi_retention_mean_by_offset(m: Models) -> DataFrame:
    rows = m.mart_patient_retention.where("months_since_acquisition BETWEEN 1 AND 12")
    return rows.groupBy("months_since_acquisition").agg(F.count("*").alias("cohorts"), cut_round(F.avg("retention_rate"), 6).alias("mean_retention"))


@query
def bi_top10_specialties(m: Models) -> DataFrame:
    return bi_specialty_table(m).orderBy(F.desc("revenue_eur"), "specialty_name").limit(10)


@query
def bi_month_to_date_fixed(m: Models) -> DataFrame:
    """Each country's revenue of the last month beside all countries' (a FIXED level of detail)."""
    rows = m.agg_monthly_country_kpis.crossJoin(F.broadcast(m.fct_appointments.agg(month_of(F.max("appointment_date")).alias("_m"))))  # one row
    rows = rows.where(F.col("month") == F.col("_m")).withColumn("cents", F.round(F.col("total_revenue_eur") * 100).cast("long"))
    total = F.sum("cents").over(Window.partitionBy())
    return rows.select("country_name", "total_revenue_eur", euros(total).alias("all_countries_eur"), F.date_format("month", "MMM yyyy").alias("label"))


@query
def bi_retention_heatmap(m: Models) -> DataFrame:
    """A row for each cohort, its retention in percent by months since acquisition, with the mean over all cohorts of months 1 and 3."""
    at = F.col("months_since_acquisition")
    rows = m.mart_patient_retention.where("months_since_acquisition BETWEEN 1 AND 12")
    means = rows.agg(*(cut_round(F.avg(F.when(at == k, F.col("retention_rate"))) * 100, 1).alias(f"mean_m{k}_pct") for k in (1, 3)))
    by = rows.groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort")).agg(*(F.max(F.when(at == k, cut_round(F.col("retention_rate") * 100, 1))).alias(f"m{k}_pct") for k in range(1, 13)))
    return by.crossJoin(F.broadcast(means))  # one row


@query
def bi_revenue_vs_target(m: Models) -> DataFrame:
    """Revenue of a month and country against a target: the same month of the year before, plus a tenth."""
    now = m.agg_monthly_country_kpis.select("month", "country_id", F.round(F.col("total_revenue_eur") * 100).cast("long").alias("cents"))
    before = now.select(F.add_months("month", 12).alias("month"), "country_id", F.col("cents").alias("before"))
    out = now.join(before, ["month", "country_id"], "left")
    return out.select("month", "country_id", euros("cents").alias("revenue_eur"), cut_round(ratio(F.col("cents") * 10, F.nullif(F.col("before") * 11, F.lit(0))) - 1, 6).alias("vs_target"))


@query
def bi_month_labels(m: Models) -> DataFrame:
    """Labels of each month with visits, and whether it is the latest."""
    months = m.fct_appointments.groupBy(month_of("appointment_date").alias("month")).agg(F.count("*").alias("visits"))
    last = months.agg(F.max("month").alias("last"))
    return months.crossJoin(F.broadcast(last)).select(  # one row
        "month", "visits", F.date_format("month", "MMM yyyy").alias("label"), F.concat(F.lit("Q"), F.quarter("month").cast("string"), F.lit(" "), F.year("month").cast("string")).alias("quarter_label"),
        (F.col("month") == F.col("last")).alias("is_current_month"),
    )


@query
def kpi_last_7_days(m: Models) -> DataFrame:
    """The latest seven days of the daily figures."""
    return m.agg_daily_business_kpis.select("date", "total_appointments", "total_leads", "completion_rate", "cumulative_appointments").orderBy(F.desc("date")).limit(7)
