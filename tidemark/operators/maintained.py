"""Aggregates kept up to date by changes of visits, payments and leads.

All that the daily and monthly figures need is kept as sums: of each day the counts and cents, and of each month and
country how many visits every patient and doctor has, since a distinct count is the number of members whose count is
not zero. A batch of changed raw rows touches some patients and leads. The facts of these before and after the batch,
taken with a negative and a positive sign, give the change of every sum; what did not change cancels. Only months with
a change are read from the kept sums and published again.
"""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import month_of
from tidemark.operators.registry import query
from tidemark.operators.tables import merged
from tidemark.operators.versions import VersionedTable
from tidemark.plans.models import DAILY_SUMS, Models, country_kpis, daily_kpis, daily_sums
from tidemark.sources.raw import PROJECTION
from tidemark.storage import keep, shared_folder

COUNT_KEY = ("month", "country_id", "what", "member")


def daily_parts(m: Models) -> DataFrame:
    return daily_sums(m).na.fill(0, list(DAILY_SUMS))


def country_parts(m: Models) -> DataFrame:
    """(month, country_id, what, member, n): sums without a member, and the number of visits by patient and doctor."""
    visits = m.fct_appointments.select(month_of("appointment_date").alias("month"), "country_id", "patient_id", "doctor_id", "status")
    one = lambda what, member="CAST(NULL AS BIGINT)": f"STRUCT('{what}' AS what, {member} AS member)"
    each = F.expr(f"array({one('visits')}, IF(status = 'completed', {one('completed')}, NULL), IF(status = 'no_show', {one('no_show')}, NULL), IF(patient_id IS NULL, NULL, {one('patient', 'patient_id')}), IF(doctor_id IS NULL, NULL, {one('doctor', 'doctor_id')}))")
    counted = visits.select("month", "country_id", F.explode(each).alias("x")).where("x IS NOT NULL").groupBy("month", "country_id", "x.what", "x.member").agg(F.count("*").alias("n"))
    paid = m.fct_payments.where("payment_status = 'paid'").groupBy(month_of("payment_date").alias("month"), "country_id").agg(F.sum("amount_cents").alias("n"))
    return counted.unionByName(paid.select("month", "country_id", F.lit("cents").alias("what"), F.lit(None).cast("long").alias("member"), "n"))


def country_figures(counts: DataFrame) -> DataFrame:
    """(month, country_id, total_appointments, ...) from sums; months and countries without a visit are left out."""
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    members = lambda what: F.count_if(F.col("what") == what).cast("long")
    return counts.groupBy("month", "country_id").agg(
        of("visits").alias("total_appointments"), of("completed").alias("completed_appointments"), of("no_show").alias("no_show_appointments"),
        members("patient").alias("unique_patients"), members("doctor").alias("active_doctors"), of("cents").alias("_cents"),
    ).where("total_appointments > 0")


@dataclass(frozen=True)
class Batch:
    """Raw rows as they are after the batch, new ones and changed ones; their keys are unique."""

    appointments: DataFrame
    payments: DataFrame
    leads: DataFrame


_KEYS = {"raw_appointments": "appointment_id", "raw_payments": "payment_id", "raw_leads": "lead_id"}


def after(raw, batch: Batch) -> SimpleNamespace:
    """The raw tables once the batch is in."""
    out = {t: getattr(raw, t) for t in PROJECTION if t.startswith("raw_")}
    for table, rows in zip(_KEYS, (batch.appointments, batch.payments, batch.leads), strict=True):
        out[table] = merged(out[table], rows, [_KEYS[table]])
    return SimpleNamespace(**out)


def _changed_visits(before, batch: Batch) -> DataFrame:
    """(appointment_id) of changed visits and of those that changed payments belong to now or belonged to."""
    payments = batch.payments.select("appointment_id").union(before.raw_payments.join(batch.payments.select("payment_id"), "payment_id", "left_semi").select("appointment_id"))
    return batch.appointments.select("appointment_id").union(payments).distinct()


def _only(raw, patients: DataFrame, leads: DataFrame) -> SimpleNamespace:
    """The raw tables with the visits of some patients, and some leads."""
    out = {t: getattr(raw, t) for t in PROJECTION if t.startswith("raw_")}
    visits = out["raw_appointments"]
    out["raw_appointments"] = keep(visits.join(patients, visits["patient_id"].eqNullSafe(patients["patient_id"]), "left_semi"), "visits")
    out["raw_leads"] = keep(out["raw_leads"].join(leads, "lead_id", "left_semi"), "leads")
    return SimpleNamespace(**out)


def touched(before, now, batch: Batch) -> tuple[SimpleNamespace, SimpleNamespace]:
    """The raw tables before and after a batch, with only those rows that the changed facts rest on.

    These are the visits of every patient with a changed visit or payment, as a patient's visits are numbered, the leads
    that changed or lead to such a visit, the visits of all these leads' patients, and the payments of all these visits.
    Both sides hold the same payments and leads, whether or not a visit is there on one side only. What is found is
    written: it is about as small as the batch, and every fact reads it.
    """
    both = (before, now)
    visits = keep(_changed_visits(before, batch), "changed_visits")
    converted = visits.withColumnRenamed("appointment_id", "converted_appointment_id")
    leads = batch.leads.select("lead_id")
    for t in both:
        leads = leads.union(t.raw_leads.join(converted, "converted_appointment_id", "left_semi").select("lead_id"))
    leads = keep(leads.distinct(), "touched_leads")
    patients = None
    for t in both:
        of_leads = t.raw_leads.join(leads, "lead_id", "left_semi").select(F.col("converted_appointment_id").alias("appointment_id"))
        own = t.raw_appointments.join(visits.union(of_leads).distinct(), "appointment_id", "left_semi").select("patient_id")
        patients = own if patients is None else patients.union(own)
    patients = keep(patients.distinct(), "touched_patients")
    sides = [_only(t, patients, leads) for t in both]
    ids = visits
    for side in sides:
        ids = ids.union(side.raw_appointments.select("appointment_id"))
    ids = keep(ids.distinct(), "touched_visits")
    for side in sides:
        side.raw_payments = keep(side.raw_payments.join(ids, "appointment_id", "left_semi"), "payments")
    return sides[0], sides[1]


class Maintained:
    """Daily and monthly sums under a folder, or those in kinds alone, one version after each batch."""

    def __init__(self, spark, folder: str, kinds: tuple[str, ...] = ("daily", "counts")):
        self.spark = spark
        self.daily = VersionedTable(spark, f"{folder}/daily", "date")
        self.counts = VersionedTable(spark, f"{folder}/counts", "month")
        both = {"daily": (self.daily, daily_parts, ["date"], list(DAILY_SUMS)), "counts": (self.counts, country_parts, list(COUNT_KEY), ["n"])}
        self._kinds = {k: both[k] for k in kinds}

    def rebuild(self, m: Models) -> None:
        for table, parts, *_ in self._kinds.values():
            table.publish(parts(m))

    def apply(self, before, batch: Batch, config=None) -> dict[str, list[str]]:
        """Takes a batch in, given the raw tables as they were, and returns the months that changed, by table."""
        old, new = (Models(self.spark, raw=t, **({"config": config} if config else {})) for t in touched(before, after(before, batch), batch))
        return {k: self._add(table, parts(old), parts(new), key, sums) for k, (table, parts, key, sums) in self._kinds.items()}

    def _add(self, table: VersionedTable, old: DataFrame, new: DataFrame, key: list[str], sums: list[str]) -> list[str]:
        total = lambda df: df.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums))
        some = " OR ".join(f"{c} <> 0" for c in sums)
        change = total(new.select(*key, *sums).union(old.select(*key, *((-F.col(c)).alias(c) for c in sums)))).where(some)
        staged = VersionedTable(self.spark, shared_folder(self.spark, "change"), table.day)
        staged.publish(change)  # a change is computed once, and its months are known before any is read
        months = staged.months()
        if months:
            table.publish(total(table.read(months=months).select(*key, *sums).union(staged.read().select(*key, *sums))).where(some), months)
        return months


def _history(m: Models) -> tuple[SimpleNamespace, Batch]:
    """Raw tables as they were before a batch, and the batch that makes them what they are: late visits, visits whose
    status was still open, payments that were pending and change without their visits, and new leads."""
    raw = m.raw
    tables = {t: getattr(raw, t) for t in PROJECTION if t.startswith("raw_")}
    late = F.col("updated_at") > F.to_timestamp_ntz(F.lit("2001-06-15 00:00:00"))
    open_visit = (F.col("appointment_id") % 7 == 0) & F.to_date("appointment_start_at").between("1996-03-01", "1996-04-30")
    pending = F.to_date("payment_created_at").between("1999-05-01", "1999-06-30")
    fresh = F.col("lead_id") % 9 == 0
    batch = Batch(keep(raw.raw_appointments.where(late | open_visit), "batch"), keep(raw.raw_payments.where(pending), "batch"), keep(raw.raw_leads.where(fresh), "batch"))
    tables["raw_appointments"] = raw.raw_appointments.where(~late).withColumn("status", F.when(open_visit, "Scheduled").otherwise(F.col("status")))
    tables["raw_payments"] = raw.raw_payments.withColumns({"payment_status": F.when(pending, "Pending").otherwise(F.col("payment_status")), "amount_cents": F.when(pending, F.col("amount_cents") + 100).otherwise(F.col("amount_cents"))})
    tables["raw_leads"] = raw.raw_leads.where(~fresh)
    return SimpleNamespace(**tables | {t: keep(tables[t], t) for t in _KEYS}), batch


def _maintained(m: Models, kind: str) -> Maintained:
    before, batch = _history(m)
    out = Maintained(m.spark, shared_folder(m.spark, "maintained"), (kind,))
    out.rebuild(Models(m.spark, raw=before, config=m.config))
    out.apply(before, batch, m.config)
    return out


@query
def maintained_daily_kpis(m: Models) -> DataFrame:
    """Daily figures after a batch, from kept sums and the change of the months it touches."""
    return daily_kpis(_maintained(m, "daily").daily.read())


@query
def maintained_country_kpis(m: Models) -> DataFrame:
    """Monthly figures by country after the same batch."""
    return country_kpis(country_figures(_maintained(m, "counts").counts.read()), m.dim_countries)
