"""Queries that run the operators on kept tables and the data tests over the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.registry import query
from tidemark.operators.tables import contract_violations, first_versions, merged, newer, next_versions
from tidemark.plans.contracts import CONTRACTS, contract
from tidemark.plans.models import Models, appointment_facts
from tidemark.plans.quality import TESTS, check_raw, failures

_MARK = "1999-01-01"


def _ts(text: str):
    return F.to_timestamp_ntz(F.lit(text))


@query
def incremental_upsert(m: Models) -> DataFrame:
    """A target of the visits known at a mark, then a run that takes what was updated after the target's newest row."""
    enriched = m.int_appointments_enriched
    target = appointment_facts(enriched.where(F.col("updated_at") <= _ts(f"{_MARK} 00:00:00"))).drop("is_missing_payment").withColumn("status", F.when(F.col("appointment_id") % 7 == 0, "scheduled").otherwise(F.col("status")))
    source = appointment_facts(enriched).withColumn("updated_at", F.when(F.col("appointment_id") % 7 == 0, F.col("updated_at") + F.expr("INTERVAL 5000 DAYS")).otherwise(F.col("updated_at")))
    out = merged(target, newer(source, target, "updated_at"), ["appointment_id"])
    return out.select("appointment_id", "status", "updated_at", "appointment_date", "is_missing_payment", "patient_appointment_sequence")


@query
def dev_window_fact(m: Models) -> DataFrame:
    return appointment_facts(m.int_appointments_enriched, dev_days=90).select("appointment_id", "appointment_date", "patient_appointment_sequence")


def _history(rows: DataFrame, changed: DataFrame, key: str, checked: tuple[str, ...]) -> DataFrame:
    first = first_versions(rows, key, _ts("2000-01-01 00:00:00"))
    out = next_versions(first, changed, key, checked, _ts("2000-02-01 00:00:00"))
    return out.select(key, *checked, F.col("dbt_valid_from").cast("string").alias("valid_from"), F.col("dbt_valid_to").cast("string").alias("valid_to"), F.col("dbt_valid_to").isNull().alias("is_current"))


@query
def scd2_doctors(m: Models) -> DataFrame:
    """Two looks: some doctors change a checked column, some only their city, some are gone, some are new."""
    rows = m.raw.raw_doctors
    second = rows.where("doctor_id % 11 <> 0").withColumns({"rating": F.when(F.col("doctor_id") % 3 == 0, F.lit(5.0)).otherwise(F.col("rating")), "city": F.lit("moved")})
    return _history(rows.where("doctor_id % 13 <> 0"), second, "doctor_id", ("is_active", "rating", "years_experience", "accepts_online_booking"))


@query
def scd2_patients(m: Models) -> DataFrame:
    rows = m.raw.raw_patients.withColumn("city", F.when(F.col("patient_id") % 5 != 0, F.col("city")))
    second = rows.withColumns({"city": F.when(F.col("patient_id") % 10 == 0, "known now").otherwise(F.col("city")), "full_name": F.lit("renamed")})
    return _history(rows.where("patient_id % 17 <> 0"), second, "patient_id", ("is_active", "city", "country_id", "acquisition_channel"))


@query
def contract_core(m: Models) -> DataFrame:
    """How many columns of each core model differ from its contract."""
    return m.spark.createDataFrame([(n, len(contract_violations(getattr(m, n), contract(n)))) for n in CONTRACTS], "model string, violations long")


@query
def dq_raw_checks(m: Models) -> DataFrame:
    """The checks of the raw tables; a table has to have as many rows as the one it is made of."""
    rows = {"specialties": 25, "doctors": m.raw.supplier, "patients": m.raw.customer, "appointments": m.raw.orders}
    return check_raw(m.raw, rows).drop("sample")


def _test(name: str):
    def run(m: Models) -> DataFrame:
        """Failing rows of the tests of this kind, one row a test so that none failing compares as well."""
        parts = [failures(m, t).agg(F.count("*").alias("failing_rows")).select(F.lit(t.name).alias("test"), F.lit(t.severity).alias("severity"), "failing_rows") for t in TESTS if t.kind == name]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    run.__name__ = f"dq_{name}"
    return query(run)


for _kind in dict.fromkeys(t.kind for t in TESTS):
    _test(_kind)
