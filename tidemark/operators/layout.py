"""Queries over written layouts: months as partitions, a space-filling order inside them, facts in buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cut_round, euros, month_of, ratio
from tidemark.operators.registry import query
from tidemark.operators.relational import PAID
from tidemark.operators.tables import footer_rows
from tidemark.plans.materialise import PARTITIONED
from tidemark.plans.models import Models
from tidemark.storage import keep_bucketed, shared_folder

#: Bits of a column's code in the space-filling order; a domain of more values shares codes between neighbours.
CODE_BITS = 8
BUCKETS = 16


def _coded(df: DataFrame, c: str) -> DataFrame:
    """df with _code_c: the place of c's value among its distinct ones, in CODE_BITS bits; null is the first.

    For columns with a small domain: the window runs over one row a value.
    """
    values = df.select(c).distinct()
    place, n = F.row_number().over(Window.orderBy(F.asc_nulls_first(c))) - 1, F.count("*").over(Window.partitionBy())
    step = F.greatest(F.ceil(n / (1 << CODE_BITS)), F.lit(1))
    values = values.select(F.col(c).alias("_value"), F.floor(place / step).cast("long").alias(f"_code_{c}"))
    return df.join(F.broadcast(values), F.col(c).eqNullSafe(F.col("_value"))).drop("_value")


def interleaved(codes: Sequence[Column]) -> Column:
    """The bits of the codes in turns, so that rows near in this number are near in every code."""
    bits = [F.shiftleft(F.shiftright(code, b).bitwiseAND(1), b * len(codes) + k) for k, code in enumerate(codes) for b in range(CODE_BITS)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def write_interleaved(df: DataFrame, path: str, day: str, cluster: Sequence[str]) -> None:
    """Parquet by month of day, rows of a month in the space-filling order of the cluster columns.

    A filter on any of these columns, not only on the first, then meets row groups whose bounds leave its value out.
    """
    month = f"{day}_month"
    rows = reduce(_coded, cluster, df).withColumn("_z", interleaved([F.col(f"_code_{c}") for c in cluster])).withColumn(month, month_of(day))
    rows = rows.repartitionByRange(month, "_z").sortWithinPartitions(month, "_z")
    rows.drop("_z", *(f"_code_{c}" for c in cluster)).write.partitionBy(month).parquet(path)


def _written_visits(m: Models) -> str:
    path = shared_folder(m.spark, "visits")
    day, cluster = PARTITIONED["fct_appointments"]
    write_interleaved(m.fct_appointments, path, day, cluster)
    return path


def kept_visits(m: Models) -> DataFrame:
    """The appointment facts as written by month and read again, with their month as partition column."""
    return m.spark.read.parquet(_written_visits(m))


@query
def partition_rows(m: Models) -> DataFrame:
    """Rows of the written fact by month, from the footers of its files."""
    return footer_rows(m.spark, _written_visits(m), "appointment_date_month")


@query
def partition_prune_month(m: Models) -> DataFrame:
    """One month of visits from the written layout: one partition is read."""
    rows = kept_visits(m).where("appointment_date_month = DATE'1996-03-01'")
    return rows.groupBy("country_id").agg(F.count("*").alias("visits"), cut_round(ratio(F.sum("patient_age_at_appointment"), F.count("*")), 2).alias("mean_age"))


def visits_of_months(visits: DataFrame, months: DataFrame) -> DataFrame:
    """Visits of the months in months (month), whose partitions alone are read though the months are only known then."""
    return visits.join(F.broadcast(months.select(F.col("month").alias("appointment_date_month"))), "appointment_date_month")  # one row a month


@query
def dynamic_month_filter(m: Models) -> DataFrame:
    """Visits by channel in the months with the most paid payments: partitions chosen while the query runs."""
    by = m.fct_payments.where(PAID).groupBy(month_of("payment_date").alias("month")).agg(F.count("*").alias("n"))
    best = by.withColumn("most", F.max("n").over(Window.partitionBy())).where("n = most")  # one row a month
    return visits_of_months(kept_visits(m), best).groupBy(F.col("appointment_date_month").alias("month"), "channel").agg(F.count("*").alias("visits"))


@query
def bucketed_star(m: Models) -> DataFrame:
    """join_inner_star over facts in buckets of the visit: the join of the two facts moves no row."""
    visits = keep_bucketed(m.fct_appointments.select("appointment_id", "appointment_date", "doctor_id", "specialty_id", "country_id"), "appointment_id", BUCKETS)
    paid = keep_bucketed(m.fct_payments.where(PAID).select("appointment_id", "amount_cents"), "appointment_id", BUCKETS)
    rows = visits.hint("merge").join(paid, "appointment_id")
    rows = rows.join(m.dim_doctors.select("doctor_id", "full_name"), "doctor_id").join(m.dim_specialties.select("specialty_id", "specialty_name"), "specialty_id")
    rows = rows.join(m.dim_countries.select("country_id", "country_name"), "country_id")
    return rows.select("appointment_id", "appointment_date", "full_name", "specialty_name", "country_name", euros("amount_cents").alias("amount_eur"))
