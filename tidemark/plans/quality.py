"""Data tests: queries for failing rows, with a severity."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.plans.models import Models


@dataclass(frozen=True)
class Test:
    __test__ = False  # pytest: not a test case

    """kind: unique, not_null, relationships, accepted_values, expression or the name of a rule of its own."""

    kind: str
    model: str
    column: str = ""
    values: tuple = ()
    to: str = ""
    expression: str = ""
    severity: str = "error"

    @property
    def name(self) -> str:
        return f"{self.kind} {self.model}" + f" {self.column or self.expression}".rstrip()


# The domains of coded columns.
STATUS = ("completed", "cancelled", "no_show", "scheduled")
CHANNEL = ("web", "app", "phone", "clinic")
PAYMENT_STATUS = ("paid", "refunded", "failed", "pending")
LEAD_SOURCE = ("seo", "sem", "direct", "referral", "social", "email")
LEAD_STATUS = ("new", "contacted", "converted", "lost")
SEGMENT = ("new", "active", "loyal", "champion", "unknown")

_KEYS = {
    "stg_appointments": "appointment_id", "stg_countries": "country_id", "stg_doctors": "doctor_id", "stg_leads": "lead_id", "stg_patients": "patient_id", "stg_payments": "payment_id",
    "stg_specialties": "specialty_id", "int_appointments_enriched": "appointment_id", "dim_patients": "patient_id", "dim_doctors": "doctor_id", "fct_appointments": "appointment_id",
    "fct_payments": "payment_id", "fct_leads": "lead_id", "agg_daily_business_kpis": "date",
}
_NOT_NULL = (
    ("fct_appointments", "patient_id"), ("fct_appointments", "doctor_id"), ("fct_appointments", "appointment_date"), ("fct_appointments", "status"), ("fct_payments", "amount_cents"),
    ("fct_leads", "lead_date"), ("dim_doctors", "specialty_id"), ("mart_patient_retention", "retention_rate"), ("agg_monthly_country_kpis", "month"), ("agg_specialty_performance", "specialty_id"),
)
_REFERS = (
    ("fct_appointments", "patient_id", "dim_patients"), ("fct_appointments", "doctor_id", "dim_doctors"), ("fct_payments", "appointment_id", "fct_appointments"),
    ("fct_leads", "patient_id", "dim_patients"), ("dim_doctors", "specialty_id", "dim_specialties"), ("dim_patients", "country_id", "dim_countries"),
)
_DOMAINS = (
    ("stg_appointments", "status", STATUS), ("stg_appointments", "channel", CHANNEL), ("stg_payments", "payment_status", PAYMENT_STATUS), ("stg_leads", "lead_source", LEAD_SOURCE),
    ("stg_leads", "lead_status", LEAD_STATUS), ("dim_patients", "patient_segment", SEGMENT), ("dim_patients", "acquisition_channel", LEAD_SOURCE),
)
_TRUE = (
    ("mart_patient_retention", "retention_rate >= 0 AND retention_rate <= 1", "error"), ("mart_appointment_quality", "completion_rate >= 0 AND completion_rate <= 1", "error"),
    ("mart_appointment_quality", "no_show_rate >= 0 AND no_show_rate <= 1", "error"), ("agg_daily_business_kpis", "cumulative_revenue_eur >= 0", "error"),
    ("fct_payments", "amount_cents > 0", "error"), ("fct_leads", "days_appointment_to_payment IS NULL OR days_appointment_to_payment >= 0", "error"),
    ("fct_leads", "days_lead_to_appointment IS NULL OR days_lead_to_appointment >= 0", "warn"), ("fct_appointments", "days_since_last_appointment IS NULL OR days_since_last_appointment >= 0", "error"),
)

TESTS: tuple[Test, ...] = (
    *(Test("unique", t, c) for t, c in _KEYS.items()),
    *(Test("not_null", t, c) for t, c in (*_KEYS.items(), *_NOT_NULL)),
    *(Test("relationships", t, c, to=to) for t, c, to in _REFERS),
    *(Test("accepted_values", t, c, values=v) for t, c, v in _DOMAINS),
    *(Test("expression", t, expression=e, severity=s) for t, e, s in _TRUE),
    Test("converted_lead_without_visit", "fct_leads"),
    Test("converted_lead_unknown_visit", "fct_leads"),
    Test("lead_country_differs", "fct_leads", severity="warn"),
    Test("completed_without_payment", "fct_appointments", severity="warn"),
    Test("visit_in_the_future", "fct_appointments"),
    Test("negative_revenue", "fct_payments"),
)


def failures(m: Models, t: Test) -> DataFrame:
    """The rows that fail a test."""
    df = getattr(m, t.model)
    if t.kind == "unique":
        return df.where(F.col(t.column).isNotNull()).groupBy(t.column).agg(F.count("*").alias("n")).where("n > 1")
    if t.kind == "not_null":
        return df.where(F.col(t.column).isNull())
    if t.kind == "relationships":
        return df.where(F.col(t.column).isNotNull()).join(getattr(m, t.to).select(t.column), t.column, "left_anti")
    if t.kind == "accepted_values":
        return df.groupBy(t.column).agg(F.count("*").alias("n")).where(~F.col(t.column).isin(*t.values))
    if t.kind == "expression":
        return df.where(f"NOT ({t.expression})")
    return RULES[t.kind](m)


def _unknown_visit(m: Models) -> DataFrame:
    leads = m.fct_leads.where("is_converted_to_appointment").select("lead_id", "appointment_id")
    return m.spark.sql("SELECT * FROM {leads} WHERE appointment_id NOT IN (SELECT appointment_id FROM {visits})", leads=leads, visits=m.fct_appointments)


def _country_differs(m: Models) -> DataFrame:
    visits = m.fct_appointments.select("appointment_id", F.col("country_id").alias("visit_country"))
    return m.fct_leads.where("is_converted_to_appointment").join(visits, "appointment_id").where("country_id <> visit_country")


def _in_future(m: Models) -> DataFrame:
    visits = m.fct_appointments.where("status IN ('completed', 'no_show', 'cancelled')")
    return visits.crossJoin(F.broadcast(m.today())).where("appointment_date > today")  # one row


RULES = {
    "converted_lead_without_visit": lambda m: m.fct_leads.where("lead_status = 'converted' AND appointment_id IS NULL"),
    "converted_lead_unknown_visit": _unknown_visit,
    "lead_country_differs": _country_differs,
    "completed_without_payment": lambda m: m.fct_appointments.where("status = 'completed' AND (payment_status IS NULL OR payment_status NOT IN ('paid', 'refunded'))"),
    "visit_in_the_future": _in_future,
    "negative_revenue": lambda m: m.fct_payments.where("amount_cents < 0"),
}


def failing_row(t: Test) -> Column | None:
    """Whether a row of the model fails, for tests that need no other row."""
    if t.kind == "not_null":
        return F.col(t.column).isNull()
    if t.kind == "accepted_values":
        return ~F.col(t.column).isin(*t.values)
    return ~F.expr(t.expression) if t.kind == "expression" else None


def watcher(tests: Sequence[Test], name: str) -> tuple[Callable[[DataFrame], DataFrame], Observation | None]:
    """A function that lets a DataFrame count the failing rows of the row tests while it is written, and where they are found.

    The counts cost no second scan. The function belongs on the last step before the write: below an exchange by ranges
    rows would be counted twice, since ranges are found from a sample of their own.
    """
    counts = [F.count_if(failing_row(t)).alias(t.name) for t in tests if failing_row(t) is not None]
    if not counts:
        return (lambda df: df), None
    seen = Observation(name)
    return (lambda df: df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)), seen


def _result(t: Test, n: int) -> dict:
    return {"test": t.name, "severity": t.severity, "failing_rows": n, "state": "pass" if not n else t.severity}


def run_tests(m: Models, tests: Sequence[Test] = TESTS) -> list[dict]:
    """One result a test: name, severity, failing rows, and pass, warn or error. One job: the row tests of a model share a scan."""
    parts = []
    for model in dict.fromkeys(t.model for t in tests):
        own = [t for t in tests if t.model == model and failing_row(t) is not None]
        if own:
            counts = getattr(m, model).agg(*(F.count_if(failing_row(t)).alias(f"t{i}") for i, t in enumerate(own)))
            pairs = F.array(*(F.struct(F.lit(t.name).alias("test"), F.col(f"t{i}").alias("n")) for i, t in enumerate(own)))
            parts.append(counts.select(F.inline(pairs)))
    for t in tests:
        if failing_row(t) is None:
            parts.append(failures(m, t).agg(F.count("*").alias("n")).select(F.lit(t.name).alias("test"), "n"))
    if not parts:
        return []
    found = {r["test"]: r["n"] for r in reduce(DataFrame.union, parts).collect()}
    return [_result(t, found[t.name]) for t in tests]


class DataTestError(ValueError):
    """A built table fails tests of severity error."""


def test_built(m: Models, model: str, seen: Observation | None, tests: Sequence[Test]) -> list[dict]:
    """Results of a model that was just written: row tests as observed by the write, the others in one job."""
    own = [t for t in tests if t.model == model]
    counts = seen.get if seen else {}
    results = [_result(t, counts[t.name]) for t in own if t.name in counts] + run_tests(m, [t for t in own if t.name not in counts])
    if bad := [r for r in results if r["state"] == "error"]:
        raise DataTestError("; ".join(f"{r['test']}: {r['failing_rows']} rows" for r in bad))
    return results


test_built.__test__ = False  # pytest: not a test


# Checks of the raw tables.


def raw_failures(raw, rows: Mapping[str, DataFrame | int]) -> dict[str, DataFrame]:
    """The failing rows of each check of the raw tables; rows: how many each of some tables has to have."""
    key = lambda table, c: getattr(raw, table).groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    lost = lambda table, own, c, to: getattr(raw, table).join(getattr(raw, to).select(c), c, "left_anti").select(own)
    other = lambda table, c, values: getattr(raw, table).select(F.lower(c).alias(c)).distinct().where(~F.col(c).isin(*values))
    visits, payments = raw.raw_appointments, raw.raw_payments
    out = {f"pk_{t}_unique": key(f"raw_{t}", c) for t, c in (("specialties", "specialty_id"), ("doctors", "doctor_id"), ("patients", "patient_id"), ("appointments", "appointment_id"), ("payments", "payment_id"))}
    out |= {
        "fk_appointments_patient": lost("raw_appointments", "appointment_id", "patient_id", "raw_patients"),
        "fk_appointments_doctor": lost("raw_appointments", "appointment_id", "doctor_id", "raw_doctors"),
        "fk_payments_appointment": lost("raw_payments", "payment_id", "appointment_id", "raw_appointments"),
        "payments_only_for_completed": payments.select("payment_id", "appointment_id").join(visits.select("appointment_id", F.lower("status").alias("status")), "appointment_id").where("status <> 'completed'"),
        "appointment_status_values": other("raw_appointments", "status", STATUS),
        "payment_status_values": other("raw_payments", "payment_status", PAYMENT_STATUS),
        "lead_status_values": other("raw_leads", "lead_status", LEAD_STATUS),
        "payment_amount_positive": payments.where("amount_cents <= 0").select("payment_id", "amount_cents"),
        "appointment_created_before_start": visits.where("appointment_created_at >= appointment_start_at").select("appointment_id", "appointment_created_at", "appointment_start_at"),
    }
    for table, want in rows.items():
        have = getattr(raw, f"raw_{table}").agg(F.count("*").alias("n"))
        want = want.agg(F.count("*").alias("wanted")) if isinstance(want, DataFrame) else have.select(F.lit(want).cast("long").alias("wanted"))
        out[f"row_count_{table}"] = have.crossJoin(F.broadcast(want)).where("n <> wanted")  # one row each
    return out


def check_raw(raw, rows: Mapping[str, DataFrame | int]) -> DataFrame:
    """(check, failing_rows, sample, state) of every check, in one job; sample is one failing row as JSON."""
    parts = [df.agg(F.count("*").alias("failing_rows"), F.min(F.to_json(F.struct("*"))).alias("sample")).withColumn("check", F.lit(name)) for name, df in raw_failures(raw, rows).items()]
    state = F.when(F.col("failing_rows") == 0, "pass").otherwise("error")
    return reduce(DataFrame.unionByName, parts).select("check", "failing_rows", "sample", state.alias("state"))


def exit_state(results: DataFrame) -> int:
    """0 if every check passes, else 1."""
    return int(not results.where("state = 'error'").isEmpty())
