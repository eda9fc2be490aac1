"""Tests of built tables in the pass that writes them, and checks of the raw tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.plans import materialise, quality
from tidemark.plans.models import Models

from .test_tables import m, small_raw  # noqa: F401


def test_row_tests_are_counted_by_the_write(spark, m, tmp_path, monkeypatch):  # noqa: F811
    """Nothing but uniqueness and references is read again, and the counts are those of separate queries."""
    own = [t for t in quality.TESTS if t.model == "fct_payments"]
    again = []
    run = quality.run_tests
    monkeypatch.setattr(quality, "run_tests", lambda models, tests=quality.TESTS: again.extend(t.kind for t in tests) or run(models, tests))
    built = Models(spark, raw=m.raw, config=m.config)
    watch, seen = quality.watcher(own, "fct_payments")
    watch(built.fct_payments).write.parquet(f"file://{tmp_path}/p")
    got = {r["test"]: r["failing_rows"] for r in quality.test_built(built, "fct_payments", seen, own)}
    assert set(again) <= {"unique", "relationships", "negative_revenue"}
    assert got == {t.name: quality.failures(m, t).count() for t in own}


def test_a_build_stops_at_a_failing_test(spark, m, tmp_path):  # noqa: F811
    """Visit 4 has no doctor: its fact is written, and nothing that rests on it is built."""
    tests = [t for t in quality.TESTS if t.kind in ("not_null", "accepted_values", "relationships", "unique")]
    with pytest.raises(quality.DataTestError, match="not_null fct_appointments doctor_id: 1 rows"):
        materialise.build(Models(spark, raw=small_raw(spark), config=m.config), f"file://{tmp_path}", tests=tests)
    assert (tmp_path / "marts" / "fct_appointments").exists() and not (tmp_path / "executive").exists()


def test_run_tests_is_one_job(spark, m):  # noqa: F811
    got = quality.run_tests(m)
    assert [r["test"] for r in got] == [t.name for t in quality.TESTS]
    some = {"not_null fct_appointments doctor_id": 1, "unique dim_patients patient_id": 0, "completed_without_payment fct_appointments": 1}
    assert {k: v for k, v in ((r["test"], r["failing_rows"]) for r in got) if k in some} == some


def test_raw_checks_find_planted_rows(spark):
    raw = SimpleNamespace(**vars(small_raw(spark)))
    raw.raw_doctors = raw.raw_doctors.union(raw.raw_doctors.limit(1))
    raw.raw_payments = raw.raw_payments.withColumn("amount_cents", F.when(F.col("payment_id") == 1, -5).otherwise(F.col("amount_cents")))
    raw.raw_leads = raw.raw_leads.withColumn("lead_status", F.when(F.col("lead_id") == 2, "odd").otherwise(F.col("lead_status")))
    results = quality.check_raw(raw, {"doctors": 2, "patients": 3})
    found = {r["check"]: r for r in results.collect()}
    assert len(found) == 16
    bad = {k: r["failing_rows"] for k, r in found.items() if r["state"] == "error"}
    assert bad == {"pk_doctors_unique": 1, "fk_appointments_doctor": 1, "payments_only_for_completed": 1, "lead_status_values": 1, "payment_amount_positive": 1, "row_count_doctors": 1}
    assert "-5" in found["payment_amount_positive"]["sample"] and "odd" in found["lead_status_values"]["sample"]
    assert quality.exit_state(results) == 1 and quality.exit_state(results.where("check = 'pk_patients_unique'")) == 0
