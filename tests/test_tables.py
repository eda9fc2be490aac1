"""Kept tables, files, streams and data tests on hand-made rows."""

import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Config
from tidemark.functions import cut_round, label_segment, months_apart, ratio, surrogate_key, years_apart
from tidemark.operators import tables
from tidemark.plans import materialise, quality
from tidemark.plans.models import MODELS, Models, appointment_facts
from tidemark.sources import files, seeds
from tidemark.streaming import upserts


def ts(text):
    return dt.datetime.fromisoformat(text)


# Column helpers.


@pytest.mark.parametrize("a, b, places, want", [(23, 40, 2, 0.58), (29, 200, 2, 0.15), (41, 40, 1, 1.0), (1, 0, 2, None), (None, 3, 2, None), (0, 3, 2, 0.0)])
def test_rounding_and_zero_denominators(spark, a, b, places, want):
    row = spark.createDataFrame([(a, b)], "a long, b long").select(cut_round(ratio(F.col("a"), F.col("b")), places)).first()
    assert row[0] == want


def test_calendar_borders(spark):
    rows = spark.createDataFrame([(dt.date(2000, 2, 1), dt.date(2000, 1, 31)), (dt.date(2001, 1, 1), dt.date(2000, 12, 31))], "a date, b date")
    assert [tuple(r) for r in rows.select(months_apart("a", "b"), years_apart("a", "b")).collect()] == [(1, 0), (1, 1)]


def test_segments(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 6, 7, None)], "n long").select(label_segment(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["new", "active", "active", "loyal", "loyal", "champion", "unknown"]


def test_surrogate_key_tells_nulls(spark):
    import hashlib

    row = spark.createDataFrame([("a", None)], "x string, y long").select(surrogate_key("x", "y")).first()
    assert row[0] == hashlib.md5(b"a|NULL").hexdigest()


# Models on small raw tables.


def small_raw(spark):
    visits = [
        (1, 1, 1, ts("2024-01-10"), ts("2024-01-31"), ts("2024-02-01"), "Completed", "WEB", ""), (2, 1, 1, ts("2024-01-10"), ts("2024-01-31"), ts("2024-02-01"), "Completed", "APP", None),
        (3, 1, 2, ts("2024-01-10"), ts("2024-02-01"), ts("2024-02-02"), "Cancelled", "APP", "ill"), (4, 2, None, ts("2024-01-10"), ts("2024-02-29"), ts("2024-03-01"), "No_Show", "PHONE", None),
    ]
    return SimpleNamespace(
        raw_appointments=spark.createDataFrame(visits, "appointment_id long, patient_id long, doctor_id long, appointment_created_at timestamp_ntz, appointment_start_at timestamp_ntz, updated_at timestamp_ntz, status string, channel string, cancellation_reason string").withColumn("is_first_appointment", F.col("appointment_id") == 1),
        raw_doctors=spark.createDataFrame([(1, "A", "s", 1, "c", dt.date(2020, 1, 1), True, 4.126, 3, True), (2, "B", "s", 1, "c", dt.date(2020, 1, 1), False, 4.0, 3, True)], "doctor_id long, full_name string, specialty_id string, country_id long, city string, created_at date, is_active boolean, rating double, years_experience long, accepts_online_booking boolean"),
        raw_patients=spark.createDataFrame([(1, "P", "F", dt.date(1999, 12, 31), 1, "c", dt.date(2020, 1, 1), "SEO", True), (2, "Q", "M", dt.date(2000, 1, 1), 1, "c", dt.date(2020, 1, 1), "SEO", True), (3, "R", "M", dt.date(2000, 1, 1), 1, "c", dt.date(2020, 1, 1), "SEO", True)], "patient_id long, full_name string, gender string, birth_date date, country_id long, city string, created_at date, acquisition_channel string, is_active boolean"),
        raw_payments=spark.createDataFrame([(1, 1, 1, 1, ts("2024-03-05"), ts("2024-03-06"), 1005, "eur", "Paid", "CARD"), (2, 3, 1, 2, ts("2024-02-01"), ts("2024-02-01"), 500, "eur", "Refunded", "CARD")], "payment_id long, appointment_id long, patient_id long, doctor_id long, payment_created_at timestamp_ntz, updated_at timestamp_ntz, amount_cents long, currency string, payment_status string, payment_method string"),
        raw_leads=spark.createDataFrame([(1, 1, "s", 2, ts("2024-01-01"), "SEO", "Converted", 1), (2, None, "s", 1, ts("2024-04-01"), "SEM", "New", None), (3, 2, "s", 1, ts("2024-01-01"), "SEM", "Converted", None)], "lead_id long, patient_id long, specialty_id string, country_id long, created_at timestamp_ntz, lead_source string, lead_status string, converted_appointment_id long"),
        raw_countries=spark.createDataFrame([(1, "X", "R", "EUR"), (2, "Y", "R", "EUR")], "country_id long, country_name string, region string, currency string"),
        raw_specialties=spark.createDataFrame([("s", "S", "g")], "specialty_id string, specialty_name string, specialty_group string"),
    )


@pytest.fixture(scope="module")
def m(spark):
    return Models(spark, raw=small_raw(spark), config=Config(as_of="2024-06-01"))


def test_enriched_ties_ages_and_missing_payments(m):
    rows = {r["appointment_id"]: r for r in m.int_appointments_enriched.collect()}
    assert [rows[i]["patient_appointment_sequence"] for i in (1, 2, 3, 4)] == [1, 2, 3, 1]
    assert [rows[i]["days_since_last_appointment"] for i in (1, 2, 3, 4)] == [None, 0, 1, None]
    assert [rows[i]["is_missing_payment"] for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert rows[1]["patient_age_at_appointment"] == 25 and rows[1]["cancellation_reason"] is None and rows[3]["cancellation_reason"] == "ill"


def test_patients_without_visits_stay(m):
    rows = {r["patient_id"]: r for r in m.dim_patients.collect()}
    assert (rows[3]["total_appointments"], rows[3]["first_appointment_date"], rows[3]["no_show_rate"], rows[3]["patient_segment"]) == (0, None, None, "new")
    assert rows[1]["total_revenue_eur"] == 10.05 and rows[1]["current_age"] == 25 and rows[1]["cohort_month"] == dt.date(2024, 1, 1)


def test_days_without_visits_count_before_they_go(m):
    rows = {str(r["date"]): r for r in m.agg_daily_business_kpis.collect()}
    assert sorted(rows) == ["2024-01-31", "2024-02-01", "2024-02-29"]
    assert rows["2024-02-29"]["cumulative_revenue_eur"] == 0.0 and rows["2024-01-31"]["total_leads"] == 0


def test_dev_window(spark, m):
    facts = appointment_facts(m.int_appointments_enriched, dev_days=28)
    assert sorted(r["appointment_id"] for r in facts.collect()) == [3, 4]
    assert Models(spark, raw=m.raw, config=Config(is_dev=True, dev_window_days=0)).fct_appointments.count() == 1


def test_data_tests_find_planted_rows(m):
    found = {r["test"]: (r["failing_rows"], r["state"]) for r in quality.run_tests(m, tuple(t for t in quality.TESTS if t.kind in quality.RULES or t.kind == "not_null"))}
    assert found["not_null fct_appointments doctor_id"] == (1, "error")
    assert found["converted_lead_without_visit fct_leads"] == (1, "error")
    assert found["lead_country_differs fct_leads"] == (1, "warn")
    assert found["completed_without_payment fct_appointments"] == (1, "warn")
    assert found["negative_revenue fct_payments"] == (0, "pass")


def test_a_second_payment_is_found(spark, m):
    raw = small_raw(spark)
    raw.raw_payments = raw.raw_payments.union(raw.raw_payments.where("payment_id = 1").withColumn("payment_id", F.lit(9).cast("long")))
    twice = Models(spark, raw=raw, config=m.config)
    (t,) = (t for t in quality.TESTS if t.name == "unique int_appointments_enriched appointment_id")
    assert quality.failures(twice, t).count() == 1


def test_build_writes_tables_and_reads_them(spark, tmp_path, m):
    built = Models(spark, raw=m.raw, config=m.config)
    paths = materialise.build(built, f"file://{tmp_path}")
    assert set(paths) == {n for n in MODELS if n.split("_")[0] not in ("stg", "int")}
    assert spark.read.parquet(paths["fct_appointments"]).select("appointment_date_month").distinct().count() == 2
    assert built.agg_monthly_country_kpis.count() == m.agg_monthly_country_kpis.count()
    assert paths["fct_appointments"] == f"file://{tmp_path}/marts/fct_appointments"

    # A later build takes rows that are newer than the newest it has, and leaves the others as they are.
    raw = small_raw(spark)
    visits = raw.raw_appointments
    one, two = (r[0] for r in visits.orderBy("appointment_id").select("appointment_id").limit(2).collect())
    late = F.lit("2099-01-01 00:00:00").cast(visits.schema["updated_at"].dataType)
    at = F.col("appointment_id")
    raw.raw_appointments = visits.withColumns({"updated_at": F.when(at == one, late).otherwise(F.col("updated_at")), "channel": F.when(at.isin(one, two), "changed").otherwise(F.col("channel"))})
    later = materialise.build(Models(spark, raw=raw, config=m.config), f"file://{tmp_path}", full_refresh=False)
    rows = {r["appointment_id"]: r["channel"] for r in spark.read.parquet(later["fct_appointments"]).collect()}
    assert rows[one] == "changed" and rows[two] != "changed" and len(rows) == m.fct_appointments.count()


def test_a_build_stops_at_a_broken_contract(spark, tmp_path, m):
    broken = Models(spark, raw=m.raw, config=m.config)
    broken._made["dim_countries"] = m.dim_countries.withColumn("currency", F.lit(1))
    with pytest.raises(ValueError, match="currency"):
        materialise.build(broken, f"file://{tmp_path}")


# Merge, history, contracts, freshness.

ROWS = "id long, day date, mark timestamp_ntz, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, dt.date.fromisoformat(d), ts(u), v) for i, d, u, v in rows], ROWS)


def test_merge_is_strict_and_adds_columns(spark):
    target = table(spark, [(1, "2024-01-01", "2024-01-01", "a"), (2, "2024-01-01", "2024-01-05", "a")])
    source = table(spark, [(1, "2024-01-01", "2024-01-06", "b"), (2, "2024-01-01", "2024-01-05", "b"), (3, "2024-02-01", "2024-01-07", "b"), (4, "2024-02-01", "2024-01-04", "late")]).withColumn("new", F.lit(1))
    out = {r["id"]: (r["v"], r["new"]) for r in tables.merged(target, tables.newer(source, target, "mark"), ["id"]).collect()}
    assert out == {1: ("b", 1), 2: ("a", None), 3: ("b", 1)}
    assert {r["id"] for r in tables.newer(source, target, "mark", "2 DAYS").collect()} == {1, 2, 3, 4}
    assert tables.newer(source, target.limit(0), "mark").count() == 4


def test_upsert_moves_rows_between_months(spark, tmp_path):
    path, staging = f"file://{tmp_path}/t", f"file://{tmp_path}/s"
    tables.write_partitioned(table(spark, [(1, "2024-01-05", "2024-01-01", "a"), (2, "2024-02-05", "2024-01-01", "a"), (3, "2024-03-05", "2024-01-01", "a")]), path, "day", ["v"])
    untouched = {p.name for p in (tmp_path / "t" / "day_month=2024-03-01").iterdir()}
    n = tables.upsert_partitioned(spark, path, table(spark, [(1, "2024-02-07", "2024-01-02", "b"), (4, "2024-04-01", "2024-01-02", "b")]), ["id"], "day", ["v"], staging)
    rows = {r["id"]: (str(r["day"]), r["v"]) for r in spark.read.parquet(path).collect()}
    assert rows == {1: ("2024-02-07", "b"), 2: ("2024-02-05", "a"), 3: ("2024-03-05", "a"), 4: ("2024-04-01", "b")}
    assert n == 3 and not (tmp_path / "t" / "day_month=2024-01-01").exists()
    assert {p.name for p in (tmp_path / "t" / "day_month=2024-03-01").iterdir()} == untouched
    some = tables.read_days(spark, path, "day", dt.date(2024, 2, 1), dt.date(2024, 2, 28))
    assert sorted(r["id"] for r in some.collect()) == [1, 2]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day_month" in plan and "PushedFilters: [IsNotNull(day)" in plan
    assert {r["bytes"] > 0 for r in tables.file_sizes(spark, path).collect()} == {True}
    assert tables.partition_sizes(some, "day").collect()[0]["n_rows"] == 2


def test_history_versions(spark):
    schema = "k long, checked string, free string"
    t0 = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "a", "x"), (5, None, "x")], schema)
    t1 = spark.createDataFrame([(1, "a", "y"), (2, "b", "x"), (3, "now", "x"), (5, None, "x"), (6, "a", "x")], schema)
    h0 = tables.first_versions(t0, "k", F.lit(ts("2024-01-01")).cast("timestamp_ntz"))
    h1 = tables.next_versions(h0, t1, "k", ["checked"], F.lit(ts("2024-01-02")).cast("timestamp_ntz"))
    h2 = tables.next_versions(h1, t1, "k", ["checked"], F.lit(ts("2024-01-03")).cast("timestamp_ntz"))
    got = sorted((r["k"], r["checked"] or "", r["free"], r["dbt_valid_to"] is None) for r in h1.collect())
    assert got == [(1, "a", "x", True), (2, "a", "x", False), (2, "b", "x", True), (3, "", "x", False), (3, "now", "x", True), (4, "a", "x", True), (5, "", "x", True), (6, "a", "x", True)]
    assert h2.count() == h1.count() and h1.select("dbt_scd_id").distinct().count() == h1.count()


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    good = T.StructType([T.StructField("y", T.StringType()), T.StructField("x", T.LongType())])
    assert tables.enforce_contract(df, good).columns == ["y", "x"]
    with pytest.raises(ValueError, match="missing column z; unexpected column y; column x is bigint, not int"):
        tables.enforce_contract(df, T.StructType([T.StructField("x", T.IntegerType()), T.StructField("z", T.LongType())]))


@pytest.mark.parametrize("hours, state", [(1, "pass"), (24, "warn"), (48, "error"), (None, "error")])
def test_freshness(spark, hours, state):
    now = dt.datetime(2024, 1, 10)
    df = spark.createDataFrame([] if hours is None else [(now - dt.timedelta(hours=hours),)], "loaded timestamp_ntz")
    assert tables.freshness(df, "loaded", F.lit(now).cast("timestamp_ntz")).first()["state"] == state


# Files and streams.


def test_csv_types_and_nulls(spark, tmp_path):
    (tmp_path / "countries.csv").write_text("country_id,country_name,region,currency\nC1,Spain,EU,EUR\n,x,y,z\n")
    (tmp_path / "payments.csv").write_text("payment_id,appointment_id,patient_id,doctor_id,payment_created_at,updated_at,amount_cents,currency,payment_status,payment_method\nP1,A1,X,D,2024-01-01 10:00:00,bad,12x,EUR,paid,card\n")
    row = files.read_csv(spark, f"file://{tmp_path}/payments.csv", files.raw_schema("payments")).first()
    assert row["amount_cents"] is None and row["updated_at"] is None and row["payment_created_at"] == ts("2024-01-01T10:00:00")
    missing = files.missing_required(files.read_csv(spark, f"file://{tmp_path}/countries.csv", files.raw_schema("countries")), files.raw_schema("countries"))
    assert [tuple(r) for r in missing.collect()] == [("country_id", 1)]


def test_extracts_and_page(spark, tmp_path, m):
    assert files.write_extracts(m, f"file://{tmp_path}/x") == sorted(files.EXTRACTS)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/x/agg_daily_business_kpis").count() == 3
    files.write_page("var d = %%DATA%%;", str(tmp_path / "p.html"), {"days": m.agg_daily_business_kpis.select("date", "total_appointments"), "none": m.fct_leads.limit(0)})
    data = json.loads((tmp_path / "p.html").read_text()[8:-1])
    assert len(data["days"]) == 3 and data["none"] == []


def test_stream_of_changes(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/t"

    def run():
        stream = spark.readStream.schema(ROWS).parquet(source)
        upserts.stream_upserts(stream, path, ["id"], "mark", "day", ["v"], f"file://{tmp_path}/c", f"file://{tmp_path}/s").awaitTermination()
        return {r["id"]: (str(r["day"]), r["v"]) for r in spark.read.parquet(path).collect()}

    table(spark, [(1, "2024-01-05", "2024-01-01", "a"), (1, "2024-01-06", "2024-01-02", "b"), (2, "2024-01-05", "2024-01-01", "a")]).write.parquet(source)
    assert run() == {1: ("2024-01-06", "b"), 2: ("2024-01-05", "a")}
    table(spark, [(2, "2024-02-01", "2024-01-03", "c")]).write.mode("append").parquet(source)
    assert run() == {1: ("2024-01-06", "b"), 2: ("2024-02-01", "c")}


def test_event_time_counts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/e")
    stream = upserts.visits_by_window(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e").withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


def test_sources_have_their_own_limits(m):
    """Small reference tables are not checked, and limits can differ by source."""
    now = F.lit(ts("2024-04-03")).cast("timestamp_ntz")
    got = {r["source"]: r["state"] for r in tables.source_freshness(m.raw, now, limits={"raw_payments": (24 * 20, 24 * 40), "raw_leads": (24, 100)}).collect()}
    assert got == {"patients": "error", "doctors": "error", "appointments": "error", "payments": "warn", "leads": "warn"}


def test_load_keeps_rejected_rows(spark, tmp_path):
    """Loaded and rejected rows are those of the file, with what is wrong in each."""
    text = "payment_id,appointment_id,patient_id,doctor_id,payment_created_at,updated_at,amount_cents,currency,payment_status,payment_method\n"
    good = "P1,A1,T1,D1,2024-01-01 10:00:00,2024-01-01 10:00:00,100,EUR,paid,card\n"
    (tmp_path / "payments.csv").write_text(text + good + good.replace("P1", "P2").replace("100", "1O0") + good.replace("P1", "").replace("2024-01-01 10:00:00", "soon", 1))
    (tmp_path / "leads.csv").write_text("lead_id,patient_id,doctor_id,specialty_id,country_id,created_at,lead_source,lead_status,converted_appointment_id\nL1,,,S1,ES,2024-01-01 00:00:00,seo,new,\n")
    try:
        assert files.load_raw(spark, f"file://{tmp_path}", "loaded") == {"payments": (1, 2), "leads": (1, 0)}
        rows = {json.loads(r["row"]).get("payment_id"): sorted((f["column"], f["reason"]) for f in r["faults"]) for r in spark.table("loaded.payments_rejected").collect()}
        assert rows == {"P2": [("amount_cents", "type")], None: [("payment_created_at", "type"), ("payment_id", "required")]}
        assert spark.table("loaded.payments").first()["amount_cents"] == 100
        assert files.load_raw(spark, f"file://{tmp_path}", "loaded")["payments"] == (1, 2)  # replaced, not added
    finally:
        spark.sql("DROP DATABASE IF EXISTS loaded CASCADE")


def test_seeds(spark, tmp_path):
    paths = seeds.load_seeds(spark, f"file://{tmp_path}")
    rows = {r["country_id"]: r for r in spark.read.parquet(paths["country_region_mapping"]).collect()}
    assert len(rows) == 8 and rows["MX"]["timezone"] == "America/Mexico_City" and rows["DE"]["language"] == "de"
