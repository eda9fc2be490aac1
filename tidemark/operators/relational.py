"""Projections, filters, joins, set operations, top-k and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import count_where, cut_round, euros, label_segment, month_of, months_apart, pct_growth, qualify, rate, ratio, surrogate_key, years_apart
from tidemark.operators.registry import query
from tidemark.plans.models import Models

DONE = "status = 'completed'"
PAID = "payment_status = 'paid'"


# Projection, filter, conditionals.


@query
def case_if_labels(m: Models) -> DataFrame:
    """Searched CASE, simple CASE and a ternary."""
    cents = F.col("amount_cents")
    label = F.when(F.col("payment_status") == "paid", "settled").when(F.col("payment_status") == "refunded", "returned").otherwise("open")
    band = F.when(cents < 1_000_000, "small").when(cents < 4_000_000, "medium").otherwise("large")
    return m.fct_payments.select("payment_id", label.alias("label"), band.alias("band"), F.expr("if(payment_method = 'card', 1, 0)").cast("long").alias("by_card"))


@query
def between_in_filter(m: Models) -> DataFrame:
    rows = m.fct_appointments.where(F.col("appointment_date").between("1996-01-01", "1996-12-31") & F.col("status").isin("completed", "no_show") & ~F.col("channel").isin("web", "phone"))
    return rows.groupBy("status", "channel").agg(F.count("*").alias("visits"))


@query
def anchored_recency(m: Models) -> DataFrame:
    """Visits of the last 90 days of the data: the bound is one row, sent to every task."""
    last = m.fct_appointments.agg(F.max("appointment_date").alias("_last"))
    rows = m.fct_appointments.crossJoin(F.broadcast(last)).where(F.col("appointment_date") >= F.date_sub("_last", 90))
    return rows.groupBy("channel").agg(F.count("*").alias("visits"), F.min("appointment_date").alias("first_date"))


@query
def except_columns(m: Models) -> DataFrame:
    return m.fct_leads.drop("lead_created_at", "appointment_created_at", "payment_created_at")


@query
def boolean_flags(m: Models) -> DataFrame:
    """Comparisons as columns: null in, null out."""
    return m.fct_leads.select("lead_id", (F.col("days_lead_to_appointment") <= 90).alias("within_90"), (F.col("amount_cents").isNull() | ~F.col("payment_status").isin("failed")).alias("not_failed"))


# Joins.


@query
def join_inner_star(m: Models) -> DataFrame:
    """Fact, payment and two dimensions: the dimensions' sizes decide how Spark joins them."""
    rows = m.fct_appointments.select("appointment_id", "doctor_id", "appointment_date").join(m.fct_payments.where(PAID).select("appointment_id", "amount_cents"), "appointment_id")
    rows = rows.join(m.dim_doctors.select("doctor_id", "full_name", "specialty_id", "country_id"), "doctor_id").join(m.dim_specialties.select("specialty_id", "specialty_name"), "specialty_id")
    rows = rows.join(m.dim_countries.select("country_id", "country_name"), "country_id")
    return rows.select("appointment_id", "appointment_date", "full_name", "specialty_name", "country_name", euros("amount_cents").alias("amount_eur"))


@query
def join_left_on_predicate(m: Models) -> DataFrame:
    """A predicate of the ON clause restricts the right side only: doctors without completed visits stay."""
    done = m.fct_appointments.where(DONE).select("doctor_id", "appointment_id")
    return m.dim_doctors.select("doctor_id", "full_name").join(done, "doctor_id", "left").groupBy("doctor_id", "full_name").agg(F.count("appointment_id").alias("completed"))


@query
def join_left_chain(m: Models) -> DataFrame:
    rows = m.stg_appointments.select("appointment_id", "doctor_id", "patient_id").join(m.stg_doctors.select("doctor_id", "specialty_id"), "doctor_id", "left")
    rows = rows.join(m.stg_patients.select("patient_id", F.col("country_id").alias("patient_country")), "patient_id", "left").join(m.stg_specialties.select("specialty_id", "specialty_group"), "specialty_id", "left")
    return rows.groupBy("specialty_group", "patient_country").agg(F.count("*").alias("visits"))


def _per_day(m: Models) -> tuple[DataFrame, DataFrame, DataFrame]:
    visits = m.fct_appointments.groupBy(F.col("appointment_date").alias("date")).agg(F.count("*").alias("visits"))
    payments = m.fct_payments.groupBy(F.col("payment_date").alias("date")).agg(F.count("*").alias("payments"))
    leads = m.fct_leads.groupBy(F.col("lead_date").alias("date")).agg(F.count("*").alias("leads"))
    return visits, payments, leads


@query
def join_full_daily(m: Models) -> DataFrame:
    visits, payments, _ = _per_day(m)
    return visits.join(payments, "date", "full").na.fill(0)


@query
def join_full_three_way(m: Models) -> DataFrame:
    visits, payments, leads = _per_day(m)
    return visits.join(payments, "date", "full").join(leads, "date", "full").na.fill(0)


@query
def join_self_repeat(m: Models) -> DataFrame:
    """Pairs of a patient's completed visits to one doctor: an equi join with an inequality beside it."""
    side = lambda p: m.fct_appointments.where(DONE).select("patient_id", "doctor_id", F.col("appointment_id").alias(f"{p}_id"), F.col("appointment_date").alias(f"{p}_date"))
    pairs = side("first").join(side("next"), ["patient_id", "doctor_id"]).where("first_date < next_date")
    return pairs.withColumn("days_between", F.datediff("next_date", "first_date").cast("long"))


def _next_visit(m: Models) -> DataFrame:
    """(patient_id, first_date, second_date): the first completed visit and the next on a later day, by one window."""
    days = m.fct_appointments.where(DONE).select("patient_id", "appointment_date").distinct()
    w = Window.partitionBy("patient_id").orderBy("appointment_date")
    return qualify(days.withColumn("second_date", F.lead("appointment_date").over(w)), F.row_number().over(w), lambda r: r == 1).withColumnRenamed("appointment_date", "first_date")


@query
def join_next_event(m: Models) -> DataFrame:
    return _next_visit(m)


@query
def anti_left_null(m: Models) -> DataFrame:
    """Appointments whose doctor is unknown, null keys included."""
    return m.fct_appointments.select("appointment_id", "doctor_id").join(m.dim_doctors.select("doctor_id"), "doctor_id", "left_anti").select("appointment_id")


@query
def anti_not_exists(m: Models) -> DataFrame:
    return m.dim_patients.select("patient_id").join(m.fct_appointments.where("status = 'no_show'"), "patient_id", "left_anti")


@query
def anti_not_in(m: Models) -> DataFrame:
    """NOT IN stays NOT IN: one null in the list and no row passes."""
    counted = "SELECT count(*) AS rows_found, '{0}' AS list FROM {{d}} WHERE doctor_id NOT IN (SELECT doctor_id FROM {{f}}{1})"
    views = {"d": m.dim_doctors.select("doctor_id"), "f": m.fct_appointments.where("status = 'cancelled'").select("doctor_id")}
    return m.spark.sql(counted.format("with nulls", ""), **views).union(m.spark.sql(counted.format("without nulls", " WHERE doctor_id IS NOT NULL"), **views))


@query
def semi_exists(m: Models) -> DataFrame:
    return m.dim_doctors.select("doctor_id", "full_name").join(m.fct_payments.where("payment_status = 'refunded'"), "doctor_id", "left_semi")


@query
def cross_anchor(m: Models) -> DataFrame:
    last = m.fct_payments.where(PAID).agg(F.max("payment_date").alias("last_date"))
    rows = m.fct_payments.where(PAID).crossJoin(F.broadcast(last))  # one row
    return rows.groupBy("last_date", F.datediff("last_date", "payment_date").between(0, 29).alias("in_last_30_days")).agg(F.count("*").alias("payments"), F.sum("amount_cents").alias("cents"))


@query
def cross_unnest(m: Models) -> DataFrame:
    """Rows times the elements of an array."""
    tags = F.array(F.col("specialty_id"), F.when(F.col("is_active"), "active").otherwise("inactive"), F.when(F.col("accepts_online_booking"), "online").otherwise("offline"))
    return m.dim_doctors.select("doctor_id", F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("doctors"))


@query
def correlated_count_rewrite(m: Models) -> DataFrame:
    """A count per row as an aggregate and a join instead of a subquery in the select list."""
    counts = m.fct_appointments.groupBy("patient_id").agg(F.count("*").alias("visits"))
    return m.dim_patients.select("patient_id", "patient_segment").join(counts, "patient_id", "left").na.fill(0, ["visits"])


@query
def correlated_max_ties(m: Models) -> DataFrame:
    """Completed visits on a patient's last day over all statuses: ties stay."""
    last = m.fct_appointments.groupBy("patient_id").agg(F.max("appointment_date").alias("appointment_date"))
    return m.fct_appointments.join(last, ["patient_id", "appointment_date"]).where(DONE).select("patient_id", "appointment_id", "appointment_date")


def _spine(days: DataFrame, column: str, step: str) -> DataFrame:
    unit = month_of if "MONTH" in step else F.to_date
    ends = days.agg(unit(F.min(column)).alias("a"), unit(F.max(column)).alias("b"))
    return ends.select(F.explode(F.expr(f"sequence(a, b, INTERVAL {step})")).alias("date"))


@query
def date_spine_zero_fill(m: Models) -> DataFrame:
    visits = m.fct_appointments.groupBy(F.col("appointment_date").alias("date")).agg(F.count("*").alias("visits"))
    return _spine(m.fct_appointments, "appointment_date", "1 DAY").join(visits, "date", "left").na.fill(0)


@query
def orphan_counts(m: Models) -> DataFrame:
    """Foreign keys without a match, by table."""
    def lost(name, fact, key, dim):
        return fact.where(F.col(key).isNotNull()).join(dim.select(key), key, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans")

    return lost("visit doctor", m.fct_appointments, "doctor_id", m.dim_doctors).union(lost("lead patient", m.fct_leads, "patient_id", m.dim_patients)).union(lost("payment visit", m.fct_payments, "appointment_id", m.fct_appointments))


# Sets and top-k.


@query
def union_row_counts(m: Models) -> DataFrame:
    names = ("dim_patients", "dim_doctors", "dim_specialties", "dim_countries", "fct_appointments", "fct_payments", "fct_leads", "mart_patient_retention", "agg_daily_business_kpis")
    parts = [getattr(m, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def recursive_month_spine(m: Models) -> DataFrame:
    """The months of the data, each made from the one before, and the visits of each. A hundred years are the bound."""
    visits = m.fct_appointments.groupBy(month_of("appointment_date").alias("date")).agg(F.count("*").alias("visits"))
    text = """
        WITH RECURSIVE months (date, last) MAX RECURSION LEVEL 1200 AS (
            SELECT min(date), max(date) FROM {visits} HAVING count(*) > 0
            UNION ALL SELECT CAST(date + INTERVAL '1' MONTH AS DATE), last FROM months WHERE date < last)
        SELECT date FROM months"""
    return m.spark.sql(text, visits=visits).join(visits, "date", "left").na.fill(0)


@query
def except_channels(m: Models) -> DataFrame:
    return m.dim_patients.select(F.col("acquisition_channel").alias("channel")).subtract(m.fct_leads.select("lead_source"))


@query
def intersect_channels(m: Models) -> DataFrame:
    """Patients with a completed visit who also came by a lead."""
    return m.fct_appointments.where(DONE).select("patient_id").intersect(m.fct_leads.select("patient_id"))


@query
def jan_not_feb(m: Models) -> DataFrame:
    """Patients seen in the first month of the data and not in the first 28 days of the second."""
    start = m.fct_appointments.agg(month_of(F.min("appointment_date")).alias("_m"))
    rows = m.fct_appointments.where(DONE).crossJoin(F.broadcast(start))  # one row
    first = rows.where(month_of("appointment_date") == F.col("_m")).select("patient_id").distinct()
    second = F.add_months("_m", 1)
    return first.join(rows.where(F.col("appointment_date").between(second, F.date_add(second, 27))), "patient_id", "left_anti")


@query
def topk_doctors(m: Models) -> DataFrame:
    paid = m.fct_payments.where(PAID).select("appointment_id", "amount_cents")
    rows = m.fct_appointments.where(DONE).select("appointment_id", "doctor_id", "patient_id").join(paid, "appointment_id", "left").groupBy("doctor_id").agg(
        F.count("*").alias("completed_appointments"), F.count_distinct("patient_id").alias("unique_patients"), F.sum("amount_cents").alias("_cents")
    )
    out = rows.join(m.dim_doctors.select("doctor_id", "full_name", "specialty_id", "country_id", "rating"), "doctor_id").orderBy(F.desc("completed_appointments"), "doctor_id").limit(20)
    return out.withColumn("total_revenue_eur", euros("_cents")).drop("_cents")


def _doctor_revenue(m: Models) -> DataFrame:
    paid = m.fct_payments.where(PAID).groupBy("doctor_id").agg(F.sum("amount_cents").alias("cents"))
    return paid.join(m.dim_doctors.select("doctor_id", "full_name", "specialty_id"), "doctor_id")


@query
def top3_in_specialty(m: Models) -> DataFrame:
    w = Window.partitionBy("specialty_id").orderBy(F.desc("cents"))
    ranked = _doctor_revenue(m).withColumn("revenue_rank", F.rank().over(w).cast("long")).where("revenue_rank <= 3")
    return ranked.withColumn("revenue_eur", euros("cents")).drop("cents")


@query
def nulls_first_inactive(m: Models) -> DataFrame:
    """Doctors without a completed visit for over 90 days, or ever; a total order, nulls first, then the first 50."""
    last = m.fct_appointments.agg(F.max("appointment_date").alias("_today"))
    seen = m.fct_appointments.where(DONE).groupBy("doctor_id").agg(F.max("appointment_date").alias("last_appointment_date"))
    rows = m.dim_doctors.select("doctor_id", "full_name", "specialty_id", "is_active").join(seen, "doctor_id", "left").crossJoin(F.broadcast(last))  # one row
    rows = rows.withColumn("days_inactive", F.datediff("_today", "last_appointment_date").cast("long")).where("days_inactive > 90 OR last_appointment_date IS NULL")
    return rows.drop("_today").orderBy(F.desc_nulls_first("days_inactive"), "doctor_id").limit(50)


# Scalar functions.


@query
def date_functions(m: Models) -> DataFrame:
    d = F.col("appointment_date")
    return m.fct_appointments.select(
        "appointment_id", month_of(d).alias("month"), F.trunc(d, "quarter").alias("quarter_start"), F.trunc(d, "year").alias("year_start"), F.date_add(d, 30).alias("plus_30_days"),
        F.add_months(d, 1).alias("plus_month"), F.date_sub(d, 7).alias("week_before"), F.datediff(d, F.to_date("appointment_created_at")).cast("long").alias("days_ahead"),
        months_apart(d, F.lit("1995-01-31").cast("date")).alias("months_since"), years_apart(d, F.lit("1994-12-31").cast("date")).alias("years_since"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.date_format(d, "MMMM yyyy").alias("month_name"), F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
    )


@query
def safe_divide_rates(m: Models) -> DataFrame:
    by = m.fct_leads.groupBy("lead_source", "lead_status").agg(F.count("*").alias("leads"), count_where(F.col("is_converted_to_appointment")).alias("visits"), count_where(F.col("is_converted_to_payment")).alias("paid"))
    return by.withColumns({"visit_rate": rate(F.col("visits"), F.col("leads")), "paid_rate": rate(F.col("paid"), F.col("visits"))})


@query
def surrogate_key_md5(m: Models) -> DataFrame:
    return m.fct_leads.select("lead_id", surrogate_key("lead_id", "lead_source", "appointment_id").alias("lead_key"))


@query
def segment_macro(m: Models) -> DataFrame:
    return m.int_patient_lifetime_metrics.select("patient_id", label_segment(F.col("completed_appointments")).alias("segment_or_unknown"))


@query
def cents_to_euros(m: Models) -> DataFrame:
    return m.fct_leads.select("lead_id", euros("amount_cents").alias("amount_eur"))


@query
def monthly_date_array(m: Models) -> DataFrame:
    return _spine(m.fct_payments, "payment_date", "1 MONTH")


@query
def mom_growth(m: Models) -> DataFrame:
    by = m.fct_appointments.groupBy(month_of("appointment_date").alias("month")).agg(F.count("*").alias("visits"))
    before = F.lag("visits").over(Window.orderBy("month"))  # one row a month
    return by.withColumn("growth_pct", cut_round(pct_growth(F.col("visits"), before) * 100, 2))


@query
def text_functions(m: Models) -> DataFrame:
    name = F.col("full_name")
    return m.dim_doctors.select(
        "doctor_id", F.upper(name).alias("upper_name"), F.lower(name).alias("lower_name"), F.substring(name, 1, 5).alias("first_five"), F.concat(name, F.lit(" ("), F.col("specialty_id").cast("string"), F.lit(")")).alias("label"),
        F.pow(F.col("years_experience").cast("double"), F.lit(2.0)).alias("experience_squared"), F.nullif(F.trim(F.lit("  ")), F.lit("")).isNull().alias("blank_is_null"),
    )


@query
def timestamp_functions(m: Models) -> DataFrame:
    """Milliseconds to and from a timestamp, intervals, and dates parsed from text; text that is no date is null."""
    at, text = F.col("appointment_start_at").cast("timestamp"), F.date_format("appointment_date", "dd/MM/yyyy")
    return m.fct_appointments.select(
        "appointment_id", F.unix_millis(at).alias("start_ms"), (F.timestamp_millis(F.unix_millis(at)) == at).alias("round_trip"), F.date_format(at - F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd HH:mm").alias("start_minus_36h"),
        F.try_to_date(text, "dd/MM/yyyy").alias("parsed"), F.try_to_date(F.concat(F.lit("99/"), text), "dd/MM/yyyy").alias("not_parsed"), (at >= F.lit("1970-01-01").cast("timestamp")).alias("after_epoch"),
    )
