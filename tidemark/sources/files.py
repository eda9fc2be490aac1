"""Files in and out: typed CSV tables, extracts, a JSON page."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import file_system

# The raw tables' columns and types.
RAW_SCHEMAS = {
    "specialties": "specialty_id string NOT NULL, specialty_name string NOT NULL, specialty_group string NOT NULL",
    "countries": "country_id string NOT NULL, country_name string NOT NULL, region string NOT NULL, currency string NOT NULL",
    "doctors": "doctor_id string NOT NULL, full_name string NOT NULL, specialty_id string NOT NULL, country_id string NOT NULL, city string NOT NULL, created_at timestamp NOT NULL, is_active boolean NOT NULL, rating double NOT NULL, years_experience bigint NOT NULL, accepts_online_booking boolean NOT NULL",
    "patients": "patient_id string NOT NULL, full_name string NOT NULL, gender string NOT NULL, birth_date date NOT NULL, country_id string NOT NULL, city string NOT NULL, created_at timestamp NOT NULL, acquisition_channel string NOT NULL, is_active boolean NOT NULL",
    "appointments": "appointment_id string NOT NULL, patient_id string NOT NULL, doctor_id string NOT NULL, appointment_created_at timestamp NOT NULL, appointment_start_at timestamp NOT NULL, updated_at timestamp NOT NULL, status string NOT NULL, channel string NOT NULL, cancellation_reason string, is_first_appointment boolean NOT NULL, source_lead_id string",
    "payments": "payment_id string NOT NULL, appointment_id string NOT NULL, patient_id string NOT NULL, doctor_id string NOT NULL, payment_created_at timestamp NOT NULL, updated_at timestamp NOT NULL, amount_cents bigint NOT NULL, currency string NOT NULL, payment_status string NOT NULL, payment_method string NOT NULL",
    "leads": "lead_id string NOT NULL, patient_id string, doctor_id string, specialty_id string NOT NULL, country_id string NOT NULL, created_at timestamp NOT NULL, lead_source string NOT NULL, lead_status string NOT NULL, converted_appointment_id string",
}
#: Marts that are exported as CSV, with the filter of each.
EXTRACTS = {"mart_patient_retention": "months_since_acquisition <= 12", "agg_daily_business_kpis": None, "agg_monthly_country_kpis": None, "agg_specialty_performance": None, "mart_doctor_supply_demand": None}


def raw_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(RAW_SCHEMAS[name])


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header, its typed columns and _rejected, the (column, reason) pairs of what is wrong in a row.

    A value that is not of its column's type is null and rejected as type, a null in a required column as required. Empty
    values are nulls.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = spark.read.schema(text).option("header", True).csv(path)
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    faults = []
    for f in schema:
        fault = F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), "type")
        fault = fault if f.nullable else fault.when(F.col(f.name).isNull(), "required")
        faults.append(F.struct(F.lit(f.name).alias("column"), fault.alias("reason")))
    rejected = F.filter(F.array(*faults), lambda x: x["reason"].isNotNull())
    return rows.select(*(c.alias(n) for n, c in typed.items()), rejected.alias("_rejected"), F.to_json(F.struct(*(F.col(f.name) for f in schema))).alias("_text"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header; values that are not of their column's type become null instead of failing the read."""
    return read_checked(spark, path, schema).drop("_rejected", "_text")


def missing_required(df: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, n_rows) for each required column that holds nulls."""
    need = [f.name for f in schema if not f.nullable]
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in need))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, need)), F.array(*need))).alias("column", "n_rows")).where("n_rows > 0")


def load_raw(spark: SparkSession, folder: str, database: str) -> dict[str, tuple[int, int]]:
    """Loads the raw CSV files that exist under folder into tables of database, replacing them; rows loaded and rejected.

    Rows with a fault go to <table>_rejected instead, with what is wrong (column, reason) and their text as JSON, so that
    both together are the rows of the file.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    out = {}
    for name in RAW_SCHEMAS:
        fs, at = file_system(spark, f"{folder}/{name}.csv")
        if not fs.exists(at):
            continue
        rows = read_checked(spark, f"{folder}/{name}.csv", raw_schema(name))
        good, bad = F.size("_rejected") == 0, F.size("_rejected") > 0
        rows.where(good).drop("_rejected", "_text").write.mode("overwrite").saveAsTable(f"{database}.{name}")
        rows.where(bad).select(F.col("_rejected").alias("faults"), F.col("_text").alias("row")).write.mode("overwrite").saveAsTable(f"{database}.{name}_rejected")
        out[name] = spark.table(f"{database}.{name}").count(), spark.table(f"{database}.{name}_rejected").count()
    return out


def write_extracts(models, folder: str) -> list[str]:
    """The dashboards' CSV extracts, one folder a mart. Marts are aggregates by month or day, so one file each."""
    for name, keep in EXTRACTS.items():
        rows = getattr(models, name)
        (rows.where(keep) if keep else rows).repartition(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    return sorted(EXTRACTS)


def page_data(parts: Mapping[str, DataFrame]) -> str:
    """One JSON object with a list of rows a part, for pages of aggregates."""
    return "{" + ", ".join(f'"{k}": [{", ".join(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())}]' for k, df in parts.items()) + "}"


def write_page(template: str, out: str, parts: Mapping[str, DataFrame], mark: str = "%%DATA%%") -> None:
    """A page with the mark in its template replaced by page_data."""
    Path(out).write_text(template.replace(mark, page_data(parts)))
