"""All models and queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import aggregates, analytics, kept, layout, maintained, relational, sketches  # noqa: F401  they register their queries
from tidemark.operators.registry import QUERIES
from tidemark.oracle import complete
from tidemark.oracle.queries import QUERY_SQL
from tidemark.plans.models import MODELS, Models

#: What the dashboards read.
EXPOSURES = {
    "executive": ("agg_daily_business_kpis", "agg_monthly_country_kpis", "agg_specialty_performance"),
    "product": ("mart_patient_retention", "mart_doctor_supply_demand", "mart_appointment_quality"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of_model(name: str):
        return lambda spark, sf_dir: getattr(Models(spark, sf_dir), name)

    def of_query(f):
        return lambda spark, sf_dir: f(Models(spark, sf_dir))

    return {name: of_model(name) for name in MODELS} | {name: of_query(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: complete(f"SELECT * FROM {name}") for name in MODELS} | {name: complete(sql) for name, sql in QUERY_SQL.items()}
