"""All models as DataFrames. ``Models(spark, sf_dir).<name>`` builds the plan of a model and of what it rests on.

A plan is built once for each Models object, so a query that uses a model twice has equal subplans, whose exchanges
Spark runs once. Nothing is computed before an action.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import count_where, cut_round, euros, euros_each, label_segment, month_of, months_apart, rate, ratio, sum_where, years_apart
from tidemark.sources.raw import Raw

MODELS: dict[str, Callable[[Models], DataFrame]] = {}
#: Layer of each model and how it is kept: views are plans, tables are written.
LAYERS = {"stg": "view", "int": "view", "dim": "table", "fct": "table", "mart": "table", "agg": "table"}


def model(f):
    MODELS[f.__name__] = f
    return f


class Models:
    """config.as_of stands for today; by default it is the last completed visit, so that results can be repeated.

    raw: anything with the raw tables as attributes, by default those made of the test tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str = "", raw: Raw | None = None, config: Config = Config()):
        self.spark, self.raw, self.config = spark, raw or Raw(spark, sf_dir), config
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in MODELS:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = MODELS[name](self)
        return self._made[name]

    def today(self) -> DataFrame:
        """One row with column today."""
        if self.config.as_of:
            return self.spark.range(1).select(F.lit(self.config.as_of).cast("date").alias("today"))
        return self.stg_appointments.where("status = 'completed'").agg(F.to_date(F.max("appointment_start_at")).alias("today"))


def _day(c: str) -> Column:
    return F.to_date(c)


# Staging: types, lower case, blanks as null.


@model
def stg_appointments(m: Models) -> DataFrame:
    return m.raw.raw_appointments.withColumns({"status": F.lower("status"), "channel": F.lower("channel"), "cancellation_reason": F.nullif(F.col("cancellation_reason"), F.lit(""))})


@model
def stg_countries(m: Models) -> DataFrame:
    return m.raw.raw_countries.select("country_id", "country_name", "region", "currency")


@model
def stg_doctors(m: Models) -> DataFrame:
    return m.raw.raw_doctors.withColumn("rating", cut_round(F.col("rating"), 2))


@model
def stg_leads(m: Models) -> DataFrame:
    return m.raw.raw_leads.withColumns({"lead_source": F.lower("lead_source"), "lead_status": F.lower("lead_status")})


@model
def stg_patients(m: Models) -> DataFrame:
    return m.raw.raw_patients.withColumn("acquisition_channel", F.lower("acquisition_channel"))


@model
def stg_payments(m: Models) -> DataFrame:
    return m.raw.raw_payments.withColumns({"currency": F.upper("currency"), "payment_status": F.lower("payment_status"), "payment_method": F.lower("payment_method")})


@model
def stg_specialties(m: Models) -> DataFrame:
    return m.raw.raw_specialties.select("specialty_id", "specialty_name", "specialty_group")


# Intermediate.


@model
def int_appointments_enriched(m: Models) -> DataFrame:
    doctors = m.stg_doctors.select("doctor_id", "specialty_id", "country_id", F.col("rating").alias("doctor_rating"))
    patients = m.stg_patients.select("patient_id", "birth_date")
    payments = m.stg_payments.select("appointment_id", "amount_cents", "payment_status", F.lit(True).alias("_has_payment"))
    visits = Window.partitionBy("patient_id").orderBy("appointment_start_at", "appointment_id")
    out = m.stg_appointments.join(doctors, "doctor_id", "left").join(patients, "patient_id", "left").join(payments, "appointment_id", "left")
    return out.select(
        *m.stg_appointments.columns, "specialty_id", "country_id", "doctor_rating",
        years_apart(_day("appointment_start_at"), "birth_date").alias("patient_age_at_appointment"),
        "amount_cents", "payment_status",
        ((F.col("status") == "completed") & F.col("_has_payment").isNull()).alias("is_missing_payment"),
        F.row_number().over(visits).cast("long").alias("patient_appointment_sequence"),
        F.datediff(_day("appointment_start_at"), F.to_date(F.lag("appointment_start_at").over(visits))).cast("long").alias("days_since_last_appointment"),
    )


def _status_counts(*names: str) -> list[Column]:
    return [count_where(F.col("status") == n).alias(f"{n}_appointments") for n in names]


@model
def int_patient_lifetime_metrics(m: Models) -> DataFrame:
    day, done = _day("appointment_start_at"), F.col("status") == "completed"
    metrics = m.int_appointments_enriched.groupBy("patient_id").agg(
        F.count("*").alias("total_appointments"), *_status_counts("completed", "cancelled", "no_show"),
        F.min(day).alias("first_appointment_date"), F.max(day).alias("last_appointment_date"), F.min(F.when(done, day)).alias("first_completed_appointment_date"),
        sum_where(F.col("payment_status") == "paid", F.col("amount_cents")).alias("total_revenue_cents"),
        F.count_distinct("specialty_id").alias("distinct_specialties_consulted"),
    )
    out = m.stg_patients.select("patient_id", "acquisition_channel", "country_id").join(metrics, "patient_id", "left")
    return out.withColumns({
        "cohort_month": month_of("first_completed_appointment_date"),
        "days_as_patient": F.datediff("last_appointment_date", "first_appointment_date").cast("long"),
        "no_show_rate": rate(F.col("no_show_appointments"), F.col("total_appointments")),
        "cancellation_rate": rate(F.col("cancelled_appointments"), F.col("total_appointments")),
    })


@model
def int_doctor_performance(m: Models) -> DataFrame:
    day = _day("appointment_start_at")
    metrics = m.int_appointments_enriched.groupBy("doctor_id").agg(
        F.count("*").alias("total_appointments"), *_status_counts("completed", "cancelled", "no_show"),
        sum_where(F.col("payment_status") == "paid", F.col("amount_cents")).alias("total_revenue_cents"),
        F.count_distinct("patient_id").alias("distinct_patients"), F.count_distinct(month_of(day)).alias("active_months"),
        F.min(day).alias("first_appointment_date"), F.max(day).alias("last_appointment_date"),
    )
    doctors = m.stg_doctors.select("doctor_id", "specialty_id", "country_id", "rating", "years_experience", "accepts_online_booking", "is_active")
    by_revenue = Window.partitionBy("specialty_id").orderBy(F.desc_nulls_last("total_revenue_cents"))
    return doctors.join(metrics, "doctor_id", "left").withColumns({
        "no_show_rate": rate(F.col("no_show_appointments"), F.col("total_appointments")),
        "completion_rate": rate(F.col("completed_appointments"), F.col("total_appointments")),
        "revenue_rank_in_specialty": F.rank().over(by_revenue).cast("long"),
    })


@model
def int_lead_to_appointment_funnel(m: Models) -> DataFrame:
    visits = m.stg_appointments.select("appointment_id", "appointment_created_at", "appointment_start_at", F.col("status").alias("appointment_status"))
    paid = m.stg_payments.where("payment_status = 'paid'").select(F.col("appointment_id").alias("_paid_id"), "payment_created_at", "amount_cents", "payment_status")
    # Leads without a visit are dealt by their own id: as nulls they would all meet in one task.
    leads = m.stg_leads.withColumn("_key", F.coalesce("converted_appointment_id", "lead_id"))
    out = leads.join(visits, (F.col("_key") == F.col("appointment_id")) & F.col("converted_appointment_id").isNotNull(), "left")
    out = out.join(paid, (F.col("_key") == F.col("_paid_id")) & F.col("appointment_id").isNotNull(), "left")
    return out.select(
        "lead_id", "patient_id", "specialty_id", "country_id", "lead_source", "lead_status", F.col("created_at").alias("lead_created_at"),
        "appointment_id", "appointment_created_at", "appointment_status", "payment_created_at", "amount_cents", "payment_status",
        F.col("appointment_id").isNotNull().alias("is_converted_to_appointment"), F.col("_paid_id").isNotNull().alias("is_converted_to_payment"),
        F.datediff(_day("appointment_start_at"), _day("created_at")).cast("long").alias("days_lead_to_appointment"),
        F.datediff(_day("payment_created_at"), _day("appointment_created_at")).cast("long").alias("days_appointment_to_payment"),
    )


# Core.


@model
def dim_patients(m: Models) -> DataFrame:
    metrics = m.int_patient_lifetime_metrics.drop("acquisition_channel", "country_id")
    out = m.stg_patients.join(metrics, "patient_id", "left").crossJoin(F.broadcast(m.today()))  # one row
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total_appointments", "completed_appointments", "total_revenue_cents")}
    out = out.withColumns(zero).withColumns({"current_age": years_apart("today", "birth_date"), "total_revenue_eur": euros("total_revenue_cents"), "patient_segment": label_segment(F.col("completed_appointments"))})
    return out.select(
        "patient_id", "full_name", "gender", "birth_date", "current_age", "country_id", "city", "created_at", "acquisition_channel", "is_active", *zero,
        "total_revenue_eur", "first_appointment_date", "last_appointment_date", "cohort_month", "no_show_rate", "cancellation_rate", "patient_segment",
    )


@model
def dim_doctors(m: Models) -> DataFrame:
    own = ["total_appointments", "completed_appointments", "total_revenue_cents"]
    more = ["no_show_rate", "completion_rate", "distinct_patients", "revenue_rank_in_specialty", "first_appointment_date", "last_appointment_date"]
    out = m.stg_doctors.join(m.int_doctor_performance.select("doctor_id", *own, *more), "doctor_id", "left")
    return out.select(*m.stg_doctors.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in own), euros(F.coalesce("total_revenue_cents", F.lit(0))).alias("total_revenue_eur"), *more)


@model
def dim_specialties(m: Models) -> DataFrame:
    return m.stg_specialties


@model
def dim_countries(m: Models) -> DataFrame:
    return m.stg_countries


@model
def fct_appointments(m: Models) -> DataFrame:
    return appointment_facts(m.int_appointments_enriched, dev_days=m.config.dev_window_days if m.config.is_dev else None)


def appointment_facts(enriched: DataFrame, newer_than: Column | None = None, dev_days: int | None = None) -> DataFrame:
    """Facts from enriched appointments. Sequences stay those of all rows: filters come after the windows.

    dev_days keeps the last days of the data, newer_than rows updated after a mark.
    """
    if dev_days is not None:
        start = enriched.agg(F.date_sub(F.to_date(F.max("appointment_start_at")), dev_days).alias("_start"))
        enriched = enriched.crossJoin(F.broadcast(start)).where(_day("appointment_start_at") >= F.col("_start")).drop("_start")  # one row
    if newer_than is not None:
        enriched = enriched.where(F.col("updated_at") > newer_than)
    return enriched.withColumns({"appointment_date": _day("appointment_start_at"), "amount_eur": euros("amount_cents")})


@model
def fct_payments(m: Models) -> DataFrame:
    doctors = m.stg_doctors.select("doctor_id", "specialty_id", "country_id")
    return m.stg_payments.join(doctors, "doctor_id", "left").withColumns({"payment_date": _day("payment_created_at"), "amount_eur": euros("amount_cents")})


@model
def fct_leads(m: Models) -> DataFrame:
    return m.int_lead_to_appointment_funnel.withColumns({"lead_date": _day("lead_created_at"), "amount_eur": euros("amount_cents")})


# Product.


@model
def mart_patient_retention(m: Models) -> DataFrame:
    patients = m.int_patient_lifetime_metrics.where("cohort_month IS NOT NULL").select("patient_id", "cohort_month")
    active = m.fct_appointments.where("status = 'completed'").select("patient_id", month_of("appointment_date").alias("activity_month")).distinct()
    kept = patients.join(active, "patient_id").groupBy("cohort_month", months_apart("activity_month", "cohort_month").alias("months_since_acquisition")).agg(F.count_distinct("patient_id").alias("retained_patients"))
    sizes = patients.groupBy("cohort_month").agg(F.count_distinct("patient_id").alias("cohort_size"))
    return kept.join(sizes, "cohort_month").withColumn("retention_rate", rate(F.col("retained_patients"), F.col("cohort_size")))


@model
def mart_doctor_supply_demand(m: Models) -> DataFrame:
    demand = m.fct_appointments.groupBy("specialty_id", "country_id", month_of("appointment_date").alias("month")).agg(
        F.count("*").alias("total_appointments"), *_status_counts("completed", "no_show"), F.count_distinct("doctor_id").alias("active_doctors_with_appointments")
    )
    supply = m.dim_doctors.groupBy("specialty_id", "country_id").agg(
        count_where(F.col("is_active")).alias("total_active_doctors"), cut_round(F.avg("rating"), 2).alias("avg_doctor_rating"), cut_round(F.avg("years_experience"), 1).alias("avg_years_experience")
    )
    return demand.join(supply, ["specialty_id", "country_id"], "left").withColumns({
        "appointments_per_doctor": cut_round(ratio(F.col("total_appointments"), F.col("total_active_doctors")), 2),
        "no_show_rate": rate(F.col("no_show_appointments"), F.col("total_appointments")),
    })


@model
def mart_appointment_quality(m: Models) -> DataFrame:
    by = m.fct_appointments.groupBy(month_of("appointment_date").alias("month"), "channel", "specialty_id", "country_id").agg(
        F.count("*").alias("total_appointments"), *(count_where(F.col("status") == s).alias(s) for s in ("completed", "cancelled", "no_show", "scheduled")), cut_round(F.avg("doctor_rating"), 2).alias("avg_doctor_rating")
    )
    return by.withColumns({f"{out}_rate": rate(F.col(c), F.col("total_appointments")) for c, out in (("completed", "completion"), ("no_show", "no_show"), ("cancelled", "cancellation"))})


# Executive.


DAILY_SUMS = (
    "total_appointments", "completed_appointments", "no_show_appointments", "new_patient_appointments", "_cents", "paid_payments", "refunded_payments", "total_leads", "converted_leads",
)


def daily_sums(m: Models) -> DataFrame:
    """(date, DAILY_SUMS); a sum is null on days without a fact of its kind."""
    visits = m.fct_appointments.groupBy(F.col("appointment_date").alias("date")).agg(
        F.count("*").alias("total_appointments"), *_status_counts("completed", "no_show"), count_where(F.col("is_first_appointment")).alias("new_patient_appointments")
    )
    paid = F.col("payment_status") == "paid"
    payments = m.fct_payments.groupBy(F.col("payment_date").alias("date")).agg(
        sum_where(paid, F.col("amount_cents")).alias("_cents"), count_where(paid).alias("paid_payments"), count_where(F.col("payment_status") == "refunded").alias("refunded_payments")
    )
    leads = m.fct_leads.groupBy(F.col("lead_date").alias("date")).agg(F.count("*").alias("total_leads"), count_where(F.col("is_converted_to_appointment")).alias("converted_leads"))
    return visits.join(payments, "date", "full").join(leads, "date", "full")


def daily_kpis(days: DataFrame) -> DataFrame:
    """Figures of each day with a visit, from its sums."""
    days = days.na.fill(0)
    # One row a day: the windows see the aggregate only. Days without visits count before they go.
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({
        "daily_revenue_eur": euros("_cents"), "completion_rate": rate(F.col("completed_appointments"), F.col("total_appointments")), "lead_conversion_rate": rate(F.col("converted_leads"), F.col("total_leads")),
        "cumulative_revenue_eur": euros(F.sum("_cents").over(running)), "cumulative_appointments": F.sum("total_appointments").over(running),
    })
    return days.where("total_appointments > 0").drop("_cents")


@model
def agg_daily_business_kpis(m: Models) -> DataFrame:
    return daily_kpis(daily_sums(m))


def _monthly(m: Models, key: str) -> DataFrame:
    return m.fct_appointments.groupBy(month_of("appointment_date").alias("month"), key).agg(
        F.count("*").alias("total_appointments"), *_status_counts("completed", "no_show"), F.count_distinct("patient_id").alias("unique_patients"), F.count_distinct("doctor_id").alias("active_doctors"),
        sum_where(F.col("payment_status") == "paid", F.col("amount_cents")).alias("_cents"),
    )


@model
def agg_monthly_country_kpis(m: Models) -> DataFrame:
    """Revenue is that of payments by their own date and doctor."""
    paid = m.fct_payments.where("payment_status = 'paid'").groupBy(month_of("payment_date").alias("month"), "country_id").agg(F.sum("amount_cents").alias("_cents"))
    out = _monthly(m, "country_id").drop("_cents").join(paid, ["month", "country_id"], "left").withColumn("_cents", F.coalesce("_cents", F.lit(0)))
    return country_kpis(out, m.dim_countries)


def country_kpis(sums: DataFrame, countries: DataFrame) -> DataFrame:
    out = sums.join(countries.select("country_id", "country_name", "region"), "country_id", "left")
    return out.withColumns({
        "total_revenue_eur": euros("_cents"), "completion_rate": rate(F.col("completed_appointments"), F.col("total_appointments")),
        "revenue_per_patient": euros_each(F.col("_cents"), F.col("unique_patients")),
        "country_revenue_rank": F.rank().over(Window.partitionBy("month").orderBy(F.desc("_cents"))).cast("long"),
    }).drop("_cents")


@model
def agg_specialty_performance(m: Models) -> DataFrame:
    """Revenue is that of the visits' payments by the visits' date."""
    out = _monthly(m, "specialty_id").join(m.dim_specialties, "specialty_id", "left")
    return out.withColumns({
        "total_revenue_eur": euros("_cents"), "completion_rate": rate(F.col("completed_appointments"), F.col("total_appointments")),
        "appointments_per_doctor": cut_round(ratio(F.col("total_appointments"), F.col("active_doctors")), 2),
        "specialty_revenue_rank": F.rank().over(Window.partitionBy("month").orderBy(F.desc("_cents"))).cast("long"),
    }).drop("_cents")
