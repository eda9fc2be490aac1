"""The seven raw tables, projected from the test tables.

The projection is plain SQL that Spark and DuckDB read alike, so that both sides of a comparison start from the same
rows; everything built on it is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

PROJECTION: dict[str, str] = {
    "raw_countries": """
        SELECT CAST(n_nationkey AS BIGINT) AS country_id, n_name AS country_name, r_name AS region,
               CASE n_regionkey WHEN 0 THEN 'ZAR' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' WHEN 3 THEN 'EUR' ELSE 'AED' END AS currency
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "raw_specialties": """
        SELECT DISTINCT p_brand AS specialty_id, concat('Practice ', substr(p_brand, 7)) AS specialty_name,
               CASE CAST(substr(p_brand, 7) AS INT) % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'surgical' WHEN 2 THEN 'diagnostic' WHEN 3 THEN 'therapy' ELSE 'mental' END AS specialty_group
        FROM {part}""",
    "raw_doctors": """
        SELECT s_suppkey AS doctor_id, s_name AS full_name, concat('Brand#', CAST(1 + s_suppkey % 25 AS VARCHAR(4))) AS specialty_id,
               CAST(s_nationkey AS BIGINT) AS country_id, concat('City ', CAST(s_suppkey % 7 AS VARCHAR(4))) AS city,
               DATE '1994-01-01' + CAST(s_suppkey % 700 AS INT) AS created_at, s_suppkey % 20 <> 0 AS is_active,
               CAST(35 + s_suppkey % 16 AS DOUBLE) / 10 AS rating, CAST(2 + s_suppkey % 29 AS BIGINT) AS years_experience,
               s_suppkey % 5 <> 0 AS accepts_online_booking
        FROM {supplier}""",
    "raw_patients": """
        SELECT c_custkey AS patient_id, c_name AS full_name, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               DATE '1950-01-01' + CAST((c_custkey * 13) % 20000 AS INT) AS birth_date, CAST(c_nationkey AS BIGINT) AS country_id,
               concat('City ', CAST(c_custkey % 7 AS VARCHAR(4))) AS city, DATE '1994-06-01' + CAST(c_custkey % 500 AS INT) AS created_at,
               c_mktsegment AS acquisition_channel, c_acctbal >= 0 AS is_active
        FROM {customer}""",
    "primary_line": """
        SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag, l_linestatus
        FROM (SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag, l_linestatus,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_rank
              FROM {lineitem}) AS ranked
        WHERE line_rank = 1""",
    "raw_appointments": """
        SELECT o_orderkey AS appointment_id, o_custkey AS patient_id, l_suppkey AS doctor_id,
               o_orderdate - INTERVAL '1' DAY * (1 + o_orderkey % 14) AS appointment_created_at, o_orderdate AS appointment_start_at,
               o_orderdate + INTERVAL '1' HOUR * (1 + o_orderkey % 48) AS updated_at,
               CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'O' THEN 'Scheduled' WHEN o_orderkey % 2 = 0 THEN 'Cancelled' ELSE 'No_Show' END AS status,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'WEB' WHEN '2' THEN 'APP' WHEN '3' THEN 'PHONE' ELSE 'CLINIC' END AS channel,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'patient' ELSE 'doctor' END END AS cancellation_reason,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first_appointment
        FROM {orders} LEFT JOIN {primary_line} ON o_orderkey = l_orderkey""",
    "raw_payments": """
        SELECT o_orderkey AS payment_id, o_orderkey AS appointment_id, o_custkey AS patient_id, l_suppkey AS doctor_id,
               o_orderdate + INTERVAL '1' DAY * l_linenumber AS payment_created_at, o_orderdate + INTERVAL '1' DAY * (l_linenumber + 1) AS updated_at,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, 'eur' AS currency,
               CASE WHEN l_returnflag = 'A' THEN 'Paid' WHEN l_returnflag = 'R' THEN 'Refunded' WHEN l_linestatus = 'F' THEN 'Failed' ELSE 'Pending' END AS payment_status,
               CASE o_orderkey % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'CASH' ELSE 'TRANSFER' END AS payment_method
        FROM {orders} JOIN {primary_line} ON o_orderkey = l_orderkey
        WHERE o_orderstatus = 'F'""",
    "raw_leads": """
        SELECT event_id AS lead_id, user_id AS patient_id, concat('Brand#', CAST(1 + event_id % 25 AS VARCHAR(4))) AS specialty_id,
               event_id % 25 AS country_id, ts - INTERVAL '29' YEAR AS created_at,
               CASE event_id % 6 WHEN 0 THEN 'SEO' WHEN 1 THEN 'SEM' WHEN 2 THEN 'Direct' WHEN 3 THEN 'Referral' WHEN 4 THEN 'Social' ELSE 'Email' END AS lead_source,
               CASE event_type WHEN 'purchase' THEN CASE WHEN o_orderkey IS NULL THEN 'contacted' ELSE 'converted' END WHEN 'signup' THEN 'new' WHEN 'error' THEN 'lost' ELSE 'contacted' END AS lead_status,
               o_orderkey AS converted_appointment_id
        FROM (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS nth
              FROM {events}) AS e
        LEFT JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth_order FROM {orders}) AS o
               ON user_id = o_custkey AND nth = nth_order""",
}


class Raw:
    """Lazy DataFrames of the test tables and of the raw tables made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES and name not in PROJECTION:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = PROJECTION[name]
                self._made[name] = self.spark.sql(text, **{t: getattr(self, t) for t in (*TABLES, *PROJECTION) if f"{{{t}}}" in text})
        return self._made[name]
