"""Versions of a table, and aggregates kept up to date by changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import maintained
from tidemark.operators.versions import VersionConflict, VersionedTable
from tidemark.plans.models import Models, country_kpis, daily_kpis
from tidemark.storage import keep


def day(text):
    return dt.date.fromisoformat(text)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "day")
    t.publish(spark.createDataFrame([(1, day("2024-01-05"), "a"), (2, day("2024-02-05"), "b"), (3, day("2024-03-05"), "c")], "id long, day date, v string"))
    return t


def test_a_row_moves_between_months(spark, table):
    table.merge(spark.createDataFrame([(1, day("2024-02-07"), "moved"), (9, day("2024-05-01"), "new")], "id long, day date, v string"), ["id"])
    assert rows_of(table.read()) == [(1, day("2024-02-07"), "moved"), (2, day("2024-02-05"), "b"), (3, day("2024-03-05"), "c"), (9, day("2024-05-01"), "new")]
    assert table.months() == ["2024-02-01", "2024-03-01", "2024-05-01"]
    assert rows_of(table.read(1)) == [(1, day("2024-01-05"), "a"), (2, day("2024-02-05"), "b"), (3, day("2024-03-05"), "c")]
    march = {f for f in table.read().inputFiles() if "2024-03-01" in f}
    assert march == {f for f in table.read(1).inputFiles() if "2024-03-01" in f}  # not written again


def test_only_wanted_months_are_read(table):
    assert all("2024-02-01" in f for f in table.read(months=["2024-02-01", "2031-01-01"]).inputFiles())
    assert table.read(months=[]).count() == 0


def test_a_crash_before_the_commit_leaves_the_table_whole(spark, table, monkeypatch):
    delta = spark.createDataFrame([(1, day("2024-02-07"), "moved")], "id long, day date, v string")
    before = rows_of(table.read())

    def crash(self, version, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", crash)
        with pytest.raises(OSError):
            table.merge(delta, ["id"])
    assert table.versions() == [1] and rows_of(table.read()) == before
    assert table.merge(delta, ["id"]) == 2 and (1, day("2024-02-07"), "moved") in rows_of(table.read())
    table.forget(1)
    assert table.versions() == [2] and table.read().count() == 3


def test_two_writers_of_one_version(spark, table, monkeypatch):
    rows = table.read()
    monkeypatch.setattr(VersionedTable, "versions", lambda self: [1])
    table.publish(rows)
    with pytest.raises(VersionConflict):
        table.publish(rows)


def test_null_days_and_empty_content(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/n", "day")
    t.publish(spark.createDataFrame([(1, None), (2, day("2024-01-01"))], "id long, day date"))
    t.merge(spark.createDataFrame([(1, day("2024-01-02"))], "id long, day date"), ["id"])
    assert rows_of(t.read()) == [(1, day("2024-01-02")), (2, day("2024-01-01"))]
    t.publish(t.read().where("false"))
    assert t.read().count() == 0 and t.read().columns == ["id", "day"]
    with pytest.raises(ValueError):
        t.publish(spark.createDataFrame([(1, day("2024-07-02"))], "id long, day date"), replaced=["2024-01-01"])


def test_batches_equal_a_rebuild(spark, small, tmp_path):
    """Two batches on kept sums: changed and late visits, a visit that goes to another patient, payments that change
    without their visits, leads that convert later."""
    m = Models(spark, small)
    before, batch = maintained._history(m)
    kept = maintained.Maintained(spark, f"file://{tmp_path}/kept")
    kept.rebuild(Models(spark, raw=before))
    changed = kept.apply(before, batch)
    # Months of open visits and of pending payments changed; those between them did not and were not read.
    assert "1996-03-01" in changed["counts"] and {"1999-05-01", "1999-06-01"} & set(changed["counts"]) and not {"1997-05-01", "1998-03-01"} & set(changed["counts"])
    assert not {f for f in kept.counts.read(months=changed["counts"]).inputFiles() if "1997-05-01" in f}

    now = maintained.after(before, batch)
    now.raw_appointments, now.raw_payments, now.raw_leads = (keep(x, "now") for x in (now.raw_appointments, now.raw_payments, now.raw_leads))
    visits = now.raw_appointments.where("appointment_id % 50 = 0").withColumns({"patient_id": F.lit(1).cast("long"), "status": F.lit("No_Show"), "appointment_start_at": F.expr("appointment_start_at + INTERVAL 40 DAYS")})
    payments = now.raw_payments.where("payment_id % 40 = 0").withColumns({"payment_status": F.lit("Paid"), "amount_cents": F.col("amount_cents") * 2})
    leads = now.raw_leads.where("lead_id % 30 = 0").withColumn("converted_appointment_id", F.lit(None).cast("long"))
    second = maintained.Batch(visits, payments, leads)
    kept.apply(now, second)
    end = maintained.after(now, second)
    end.raw_appointments, end.raw_payments, end.raw_leads = (keep(x, "end") for x in (end.raw_appointments, end.raw_payments, end.raw_leads))
    full = Models(spark, raw=end)
    got, want = daily_kpis(kept.daily.read()), full.agg_daily_business_kpis
    assert rows_of(got.select(sorted(got.columns))) == rows_of(want.select(sorted(want.columns)))
    got, want = country_kpis(maintained.country_figures(kept.counts.read()), full.dim_countries), full.agg_monthly_country_kpis
    plain = lambda df: sorted((tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()))
    assert plain(got) == plain(want)
    assert kept.apply(end, maintained.Batch(visits.where("false"), payments.where("false"), leads.where("false"))) == {"daily": [], "counts": []}


def test_only_one_of_the_sums_is_kept(spark, small):
    """A query that asks for daily figures neither builds nor publishes the monthly ones, and the other way round."""
    m = Models(spark, small)
    for kind, other in (("daily", "counts"), ("counts", "daily")):
        kept = maintained._maintained(m, kind)
        assert getattr(kept, kind).versions() == [1, 2] and getattr(kept, other).versions() == []
