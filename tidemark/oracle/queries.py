"""SQL of the queries, over raw tables and models."""

from tidemark.oracle.models import MONTH, cut, div, each, n, rate

M = MONTH.format("appointment_date")
PM = MONTH.format("payment_date")
PAID, DONE = "payment_status = 'paid'", "status = 'completed'"
EUR = "CAST({} AS BIGINT) / 100.0::DOUBLE"


def eur(x: str) -> str:
    return EUR.format(x)


_SPINE = "SELECT CAST(unnest(generate_series({0}, {1}, INTERVAL 1 {2})) AS DATE) AS date"
_VISITS = "WINDOW v AS (PARTITION BY patient_id ORDER BY appointment_start_at, appointment_id)"
_REVENUE = f"SELECT y.doctor_id, d.full_name, d.specialty_id, CAST(sum(y.amount_cents) AS BIGINT) AS cents FROM fct_payments y JOIN dim_doctors d USING (doctor_id) WHERE {PAID} GROUP BY ALL"
_NEXT = f"SELECT f.patient_id, f.first_date, min(a.appointment_date) AS second_date FROM (SELECT patient_id, min(appointment_date) AS first_date FROM fct_appointments WHERE {DONE} GROUP BY 1) f LEFT JOIN fct_appointments a ON a.patient_id = f.patient_id AND a.appointment_date > f.first_date AND a.{DONE} GROUP BY 1, 2"
_RECENCY = f"SELECT patient_id, last_appointment_date, d AS days_since_last_visit, CASE WHEN d <= 90 THEN 'active' WHEN d <= 365 THEN 'at_risk' ELSE 'churned' END AS patient_segment FROM (SELECT patient_id, max(appointment_date) AS last_appointment_date, (SELECT max(appointment_date) FROM fct_appointments WHERE {DONE}) - max(appointment_date) AS d FROM fct_appointments WHERE {DONE} GROUP BY 1)"
_SPECIALTY = f"SELECT specialty_name, CAST(sum(total_appointments) AS BIGINT) AS appointments, CAST(sum(completed_appointments) AS BIGINT) AS completed, CAST(sum(CAST(round(total_revenue_eur * 100) AS BIGINT)) AS BIGINT) AS cents FROM agg_specialty_performance GROUP BY 1"
_SPECIALTY = f"SELECT specialty_name, appointments, completed, {eur('cents')} AS revenue_eur, {each('cents', 'completed')} AS ticket_eur, {cut(div('appointments', '(sum(appointments) OVER ())'), 6)} AS demand_share FROM ({_SPECIALTY})"

_COUNTRY_CENTS = "SELECT month, country_id, CAST(round(total_revenue_eur * 100) AS BIGINT) AS c FROM agg_monthly_country_kpis"


def _lost(name, fact, key, dim):
    return f"SELECT '{name}' AS relation, count(*) AS orphans FROM {fact} f WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{key} = f.{key})"


def _since(unit: str) -> str:
    return eur(f"sum(amount_cents) FILTER (WHERE payment_date >= date_trunc('{unit}', (SELECT max(payment_date) FROM fct_payments WHERE {PAID})))")


_SPANS = "(SELECT {0} AS month, {1} FROM {2} GROUP BY 1 UNION ALL SELECT NULL, {1} FROM {2})"
_ACTIVE = f"SELECT DISTINCT channel, patient_id FROM fct_appointments WHERE {DONE}"

_STAR = f"SELECT a.appointment_id, a.appointment_date, d.full_name, s.specialty_name, c.country_name, {eur('y.amount_cents')} AS amount_eur FROM fct_appointments a JOIN fct_payments y ON a.appointment_id = y.appointment_id AND y.{PAID} JOIN dim_doctors d ON a.doctor_id = d.doctor_id JOIN dim_specialties s ON d.specialty_id = s.specialty_id JOIN dim_countries c ON d.country_id = c.country_id"



def _raw_checks() -> str:
    twice = lambda t, c: f"SELECT {c} FROM raw_{t} GROUP BY 1 HAVING count(*) > 1"
    lost = lambda t, c, to: f"SELECT 1 FROM raw_{t} x WHERE NOT EXISTS (SELECT 1 FROM raw_{to} y WHERE y.{c} = x.{c})"
    other = lambda t, c, values: f"SELECT DISTINCT lower({c}) FROM raw_{t} WHERE lower({c}) NOT IN {values}"
    size = lambda t, n: f"SELECT 1 FROM (SELECT count(*) AS n FROM raw_{t}) WHERE n <> {n}"
    checks = {
        "pk_specialties_unique": twice("specialties", "specialty_id"), "pk_doctors_unique": twice("doctors", "doctor_id"), "pk_patients_unique": twice("patients", "patient_id"),
        "pk_appointments_unique": twice("appointments", "appointment_id"), "pk_payments_unique": twice("payments", "payment_id"),
        "fk_appointments_patient": lost("appointments", "patient_id", "patients"), "fk_appointments_doctor": lost("appointments", "doctor_id", "doctors"), "fk_payments_appointment": lost("payments", "appointment_id", "appointments"),
        "payments_only_for_completed": "SELECT 1 FROM raw_payments p JOIN raw_appointments a USING (appointment_id) WHERE lower(a.status) <> 'completed'",
        "appointment_status_values": other("appointments", "status", "('completed', 'cancelled', 'no_show', 'scheduled')"), "payment_status_values": other("payments", "payment_status", "('paid', 'refunded', 'failed', 'pending')"),
        "lead_status_values": other("leads", "lead_status", "('new', 'contacted', 'lost', 'converted')"), "payment_amount_positive": "SELECT 1 FROM raw_payments WHERE amount_cents <= 0",
        "appointment_created_before_start": "SELECT 1 FROM raw_appointments WHERE appointment_created_at >= appointment_start_at",
        "row_count_specialties": size("specialties", 25), "row_count_doctors": size("doctors", "(SELECT count(*) FROM supplier)"), "row_count_patients": size("patients", "(SELECT count(*) FROM customer)"), "row_count_appointments": size("appointments", "(SELECT count(*) FROM orders)"),
    }
    counts = " UNION ALL ".join(f"SELECT '{name}' AS check_name, (SELECT count(*) FROM ({sql})) AS n" for name, sql in checks.items())
    return f"""SELECT check_name AS "check", n AS failing_rows, CASE WHEN n = 0 THEN 'pass' ELSE 'error' END AS state FROM ({counts})"""


QUERY_SQL = {
    "dq_raw_checks": _raw_checks(),
    "dynamic_month_filter": f"SELECT {M} AS month, channel, count(*) AS visits FROM fct_appointments WHERE {M} IN (SELECT {PM} FROM fct_payments WHERE {PAID} GROUP BY 1 QUALIFY count(*) = max(count(*)) OVER ()) GROUP BY 1, 2",
    "maintained_daily_kpis": "SELECT * FROM agg_daily_business_kpis",
    "maintained_country_kpis": "SELECT * FROM agg_monthly_country_kpis",
    "sketched_patients": "SELECT month, patients, TRUE AS close FROM " + _SPANS.format(M, "count(DISTINCT patient_id) AS patients", "fct_appointments"),
    "sketched_amounts": "SELECT month, payments, TRUE AS n_equal, TRUE AS q1_close, TRUE AS median_close, TRUE AS q3_close FROM " + _SPANS.format(PM, "count(*) AS payments", f"(SELECT * FROM fct_payments WHERE {PAID})"),
    "sketched_retention": "SELECT cohort_month, months_since_acquisition, retained_patients, TRUE AS close FROM mart_patient_retention",
    "channel_overlap": f"SELECT a.channel, count(*) AS patients, count(w.patient_id) AS also_web, TRUE AS both_close, TRUE AS only_close FROM ({_ACTIVE}) a LEFT JOIN (SELECT patient_id FROM ({_ACTIVE}) WHERE channel = 'web') w USING (patient_id) GROUP BY 1",
    "phone_not_web": f"SELECT patient_id FROM fct_appointments WHERE {DONE} AND channel = 'phone' EXCEPT SELECT patient_id FROM fct_appointments WHERE {DONE} AND channel = 'web'",
    "case_if_labels": "SELECT payment_id, CASE payment_status WHEN 'paid' THEN 'settled' WHEN 'refunded' THEN 'returned' ELSE 'open' END AS label, CASE WHEN amount_cents < 1000000 THEN 'small' WHEN amount_cents < 4000000 THEN 'medium' ELSE 'large' END AS band, CASE WHEN payment_method = 'card' THEN 1 ELSE 0 END::BIGINT AS by_card FROM fct_payments",
    "between_in_filter": "SELECT status, channel, count(*) AS visits FROM fct_appointments WHERE appointment_date BETWEEN '1996-01-01' AND '1996-12-31' AND status IN ('completed', 'no_show') AND channel NOT IN ('web', 'phone') GROUP BY 1, 2",
    "anchored_recency": "SELECT channel, count(*) AS visits, min(appointment_date) AS first_date FROM fct_appointments WHERE appointment_date >= (SELECT max(appointment_date) FROM fct_appointments) - 90 GROUP BY 1",
    "except_columns": "SELECT * EXCLUDE (lead_created_at, appointment_created_at, payment_created_at) FROM fct_leads",
    "boolean_flags": "SELECT lead_id, days_lead_to_appointment <= 90 AS within_90, amount_cents IS NULL OR payment_status NOT IN ('failed') AS not_failed FROM fct_leads",
    "join_inner_star": _STAR,
    "bucketed_star": _STAR,
    "join_left_on_predicate": f"SELECT d.doctor_id, d.full_name, count(a.appointment_id) AS completed FROM dim_doctors d LEFT JOIN fct_appointments a ON a.doctor_id = d.doctor_id AND a.{DONE} GROUP BY 1, 2",
    "join_left_chain": "SELECT s.specialty_group, p.country_id AS patient_country, count(*) AS visits FROM stg_appointments a LEFT JOIN stg_doctors d ON a.doctor_id = d.doctor_id LEFT JOIN stg_patients p ON a.patient_id = p.patient_id LEFT JOIN stg_specialties s ON d.specialty_id = s.specialty_id GROUP BY 1, 2",
    "join_full_daily": "SELECT date, coalesce(visits, 0) AS visits, coalesce(payments, 0) AS payments FROM (SELECT appointment_date AS date, count(*) AS visits FROM fct_appointments GROUP BY 1) a FULL JOIN (SELECT payment_date AS date, count(*) AS payments FROM fct_payments GROUP BY 1) y USING (date)",
    "join_full_three_way": "SELECT date, coalesce(visits, 0) AS visits, coalesce(payments, 0) AS payments, coalesce(leads, 0) AS leads FROM (SELECT appointment_date AS date, count(*) AS visits FROM fct_appointments GROUP BY 1) a FULL JOIN (SELECT payment_date AS date, count(*) AS payments FROM fct_payments GROUP BY 1) y USING (date) FULL JOIN (SELECT lead_date AS date, count(*) AS leads FROM fct_leads GROUP BY 1) l USING (date)",
    "join_self_repeat": f"SELECT a.patient_id, a.doctor_id, a.appointment_id AS first_id, a.appointment_date AS first_date, b.appointment_id AS next_id, b.appointment_date AS next_date, b.appointment_date - a.appointment_date AS days_between FROM fct_appointments a JOIN fct_appointments b ON a.patient_id = b.patient_id AND a.doctor_id = b.doctor_id AND a.appointment_date < b.appointment_date WHERE a.{DONE} AND b.{DONE}",
    "join_next_event": _NEXT,
    "anti_left_null": "SELECT a.appointment_id FROM fct_appointments a LEFT JOIN dim_doctors d ON a.doctor_id = d.doctor_id WHERE d.doctor_id IS NULL",
    "anti_not_exists": "SELECT patient_id FROM dim_patients p WHERE NOT EXISTS (SELECT 1 FROM fct_appointments a WHERE a.patient_id = p.patient_id AND a.status = 'no_show')",
    "anti_not_in": "SELECT count(*) AS rows_found, 'with nulls' AS list FROM dim_doctors WHERE doctor_id NOT IN (SELECT doctor_id FROM fct_appointments WHERE status = 'cancelled') UNION ALL SELECT count(*), 'without nulls' FROM dim_doctors WHERE doctor_id NOT IN (SELECT doctor_id FROM fct_appointments WHERE status = 'cancelled' AND doctor_id IS NOT NULL)",
    "semi_exists": "SELECT doctor_id, full_name FROM dim_doctors d WHERE EXISTS (SELECT 1 FROM fct_payments y WHERE y.doctor_id = d.doctor_id AND y.payment_status = 'refunded')",
    "cross_anchor": f"SELECT last_date, last_date - payment_date BETWEEN 0 AND 29 AS in_last_30_days, count(*) AS payments, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fct_payments, (SELECT max(payment_date) AS last_date FROM fct_payments WHERE {PAID}) WHERE {PAID} GROUP BY 1, 2",
    "cross_unnest": "SELECT tag, count(*) AS doctors FROM (SELECT unnest([specialty_id, CASE WHEN is_active THEN 'active' ELSE 'inactive' END, CASE WHEN accepts_online_booking THEN 'online' ELSE 'offline' END]) AS tag FROM dim_doctors) GROUP BY 1",
    "correlated_count_rewrite": "SELECT patient_id, patient_segment, (SELECT count(*) FROM fct_appointments a WHERE a.patient_id = p.patient_id) AS visits FROM dim_patients p",
    "correlated_max_ties": f"SELECT patient_id, appointment_id, appointment_date FROM fct_appointments a WHERE {DONE} AND appointment_date = (SELECT max(appointment_date) FROM fct_appointments b WHERE b.patient_id = a.patient_id)",
    "date_spine_zero_fill": f"SELECT s.date, count(a.appointment_id) AS visits FROM ({_SPINE.format('(SELECT min(appointment_date) FROM fct_appointments)', '(SELECT max(appointment_date) FROM fct_appointments)', 'DAY')}) s LEFT JOIN fct_appointments a ON a.appointment_date = s.date GROUP BY 1",
    "orphan_counts": f"{_lost('visit doctor', 'fct_appointments', 'doctor_id', 'dim_doctors')} UNION ALL {_lost('lead patient', 'fct_leads', 'patient_id', 'dim_patients')} UNION ALL {_lost('payment visit', 'fct_payments', 'appointment_id', 'fct_appointments')}",
    "union_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("dim_patients", "dim_doctors", "dim_specialties", "dim_countries", "fct_appointments", "fct_payments", "fct_leads", "mart_patient_retention", "agg_daily_business_kpis")),
    "recursive_month_spine": f"WITH RECURSIVE months AS (SELECT {MONTH.format('min(appointment_date)')} AS date FROM fct_appointments UNION ALL SELECT CAST(date + INTERVAL 1 MONTH AS DATE) FROM months WHERE date < (SELECT {MONTH.format('max(appointment_date)')} FROM fct_appointments)) SELECT date, count(a.appointment_id) AS visits FROM months LEFT JOIN fct_appointments a ON {MONTH.format('a.appointment_date')} = date GROUP BY 1",
    "except_channels": "SELECT acquisition_channel AS channel FROM dim_patients EXCEPT SELECT lead_source FROM fct_leads",
    "intersect_channels": f"SELECT patient_id FROM fct_appointments WHERE {DONE} INTERSECT SELECT patient_id FROM fct_leads",
    "jan_not_feb": f"WITH edge AS (SELECT {MONTH.format('min(appointment_date)')} AS m FROM fct_appointments) SELECT DISTINCT patient_id FROM fct_appointments a, edge WHERE {DONE} AND {M} = m AND NOT EXISTS (SELECT 1 FROM fct_appointments b, edge e WHERE b.patient_id = a.patient_id AND b.{DONE} AND b.appointment_date BETWEEN CAST(e.m + INTERVAL 1 MONTH AS DATE) AND CAST(e.m + INTERVAL 1 MONTH AS DATE) + 27)",
    "topk_doctors": f"SELECT d.doctor_id, d.full_name, d.specialty_id, d.country_id, d.rating, count(*) AS completed_appointments, count(DISTINCT a.patient_id) AS unique_patients, {eur('sum(y.amount_cents)')} AS total_revenue_eur FROM fct_appointments a JOIN dim_doctors d ON a.doctor_id = d.doctor_id LEFT JOIN fct_payments y ON y.appointment_id = a.appointment_id AND y.{PAID} WHERE a.{DONE} GROUP BY ALL ORDER BY completed_appointments DESC, d.doctor_id LIMIT 20",
    "top3_in_specialty": f"SELECT doctor_id, full_name, specialty_id, {eur('cents')} AS revenue_eur, rank() OVER (PARTITION BY specialty_id ORDER BY cents DESC) AS revenue_rank FROM ({_REVENUE}) QUALIFY revenue_rank <= 3",
    "nulls_first_inactive": f"SELECT * FROM (SELECT d.doctor_id, d.full_name, d.specialty_id, d.is_active, max(a.appointment_date) AS last_appointment_date, (SELECT max(appointment_date) FROM fct_appointments) - max(a.appointment_date) AS days_inactive FROM dim_doctors d LEFT JOIN fct_appointments a ON a.doctor_id = d.doctor_id AND a.{DONE} GROUP BY 1, 2, 3, 4) WHERE days_inactive > 90 OR last_appointment_date IS NULL ORDER BY days_inactive DESC NULLS FIRST, doctor_id LIMIT 50",
    "date_functions": f"SELECT appointment_id, {M} AS month, CAST(date_trunc('quarter', appointment_date) AS DATE) AS quarter_start, CAST(date_trunc('year', appointment_date) AS DATE) AS year_start, appointment_date + 30 AS plus_30_days, CAST(appointment_date + INTERVAL 1 MONTH AS DATE) AS plus_month, appointment_date - 7 AS week_before, appointment_date - CAST(appointment_created_at AS DATE) AS days_ahead, date_diff('month', DATE '1995-01-31', appointment_date) AS months_since, date_diff('year', DATE '1994-12-31', appointment_date) AS years_since, strftime(appointment_date, '%Y-%m') AS year_month, strftime(appointment_date, '%B %Y') AS month_name, concat(year(appointment_date), '-Q', quarter(appointment_date)) AS year_quarter FROM fct_appointments",
    "safe_divide_rates": f"SELECT lead_source, lead_status, count(*) AS leads, {n('is_converted_to_appointment')} AS visits, {n('is_converted_to_payment')} AS paid, {rate(n('is_converted_to_appointment'), 'count(*)')} AS visit_rate, {rate(n('is_converted_to_payment'), n('is_converted_to_appointment'))} AS paid_rate FROM fct_leads GROUP BY 1, 2",
    "surrogate_key_md5": "SELECT lead_id, md5(concat(lead_id, '|', coalesce(lead_source, 'NULL'), '|', coalesce(CAST(appointment_id AS VARCHAR), 'NULL'))) AS lead_key FROM fct_leads",
    "segment_macro": "SELECT patient_id, CASE WHEN completed_appointments = 0 THEN 'new' WHEN completed_appointments BETWEEN 1 AND 2 THEN 'active' WHEN completed_appointments BETWEEN 3 AND 6 THEN 'loyal' WHEN completed_appointments > 6 THEN 'champion' ELSE 'unknown' END AS segment_or_unknown FROM int_patient_lifetime_metrics",
    "cents_to_euros": f"SELECT lead_id, {eur('amount_cents')} AS amount_eur FROM fct_leads",
    "monthly_date_array": _SPINE.format(f"(SELECT {MONTH.format('min(payment_date)')} FROM fct_payments)", f"(SELECT {MONTH.format('max(payment_date)')} FROM fct_payments)", "MONTH"),
    "mom_growth": f"SELECT month, visits, {cut('100.0::DOUBLE * ' + div('(visits - lag(visits) OVER (ORDER BY month))', '(lag(visits) OVER (ORDER BY month))'), 2)} AS growth_pct FROM (SELECT {M} AS month, count(*) AS visits FROM fct_appointments GROUP BY 1)",
    "partition_prune_month": f"SELECT country_id, count(*) AS visits, {cut(div('sum(patient_age_at_appointment)', 'count(*)'), 2)} AS mean_age FROM fct_appointments WHERE {M} = DATE '1996-03-01' GROUP BY 1",
    "countif_monthly": f"SELECT {M} AS month, count(*) AS total, " + ", ".join(f"{n(f"status = '{s}'")} AS {s}" for s in ("completed", "cancelled", "no_show", "scheduled")) + " FROM fct_appointments GROUP BY 1",
    "multi_count_distinct": f"SELECT channel, count(DISTINCT patient_id) AS patients, count(DISTINCT doctor_id) AS doctors, count(DISTINCT {M}) AS months, count(DISTINCT specialty_id) AS specialties FROM fct_appointments GROUP BY 1",
    "conditional_sum": "SELECT country_id, " + ", ".join(f"CAST(sum(CASE WHEN payment_status = '{s}' THEN amount_cents ELSE 0 END) AS BIGINT) AS {s}_cents" for s in ("paid", "refunded", "failed")) + " FROM fct_payments GROUP BY 1",
    "two_level_agg": f"SELECT channel, count(*) AS patients, {cut('avg(k)', 4)} AS mean_visits, max(k) AS most_visits FROM (SELECT patient_id, channel, count(*) AS k FROM fct_appointments GROUP BY 1, 2) GROUP BY 1",
    "share_of_group_join": f"SELECT doctor_id, specialty_id, doc_completed, CAST(sum(doc_completed) OVER (PARTITION BY specialty_id) AS BIGINT) AS spec_completed, {div('doc_completed', '(sum(doc_completed) OVER (PARTITION BY specialty_id))')} AS share FROM (SELECT doctor_id, specialty_id, {n(DONE)} AS doc_completed FROM fct_appointments WHERE specialty_id IS NOT NULL GROUP BY 1, 2)",
    "pivot_channel_revenue": f"SELECT {M} AS month, " + ", ".join(f"CAST(coalesce(sum(amount_cents) FILTER (WHERE channel = '{c}'), 0) AS BIGINT) AS {c}_cents" for c in ("web", "app", "phone", "clinic")) + f" FROM fct_appointments WHERE {PAID} GROUP BY 1",
    "pivot_cohort_m0_m6": "SELECT cohort_month, cohort_size, max(retained_patients) FILTER (WHERE months_since_acquisition = 0) AS m0, " + ", ".join(f"max(retention_rate) FILTER (WHERE months_since_acquisition = {k}) AS ret_m{k}" for k in range(1, 7)) + " FROM mart_patient_retention GROUP BY 1, 2",
    "array_agg_struct": "SELECT patient_id, count(*) AS visits, string_agg(concat(appointment_date, ':', status), ',' ORDER BY appointment_date, appointment_id) AS history FROM fct_appointments GROUP BY 1",
    "string_agg_distinct": "SELECT doctor_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, count(DISTINCT channel) AS n FROM fct_appointments GROUP BY 1 HAVING n >= 2",
    "approx_distinct": "SELECT status, count(DISTINCT patient_id) AS patients, true AS close FROM fct_appointments GROUP BY 1",
    "quantiles_exact": "SELECT payment_status, min(amount_cents) AS least, quantile_disc(amount_cents, 0.25) AS q1, quantile_disc(amount_cents, 0.5) AS median, quantile_disc(amount_cents, 0.75) AS q3, max(amount_cents) AS most FROM fct_payments GROUP BY 1",
    "quantiles_approx": "SELECT payment_status, min(amount_cents) AS least, true AS q1_close, true AS median_close, true AS q3_close, max(amount_cents) AS most FROM fct_payments GROUP BY 1",
    "null_audit": "SELECT count(*) AS n_rows, " + ", ".join(f"{n(f'{c} IS NULL')} AS null_{c}" for c in ("doctor_id", "cancellation_reason", "amount_cents", "days_since_last_appointment", "specialty_id")) + " FROM fct_appointments",
    "rounded_bucket": f"SELECT {cut('avg_doctor_rating', 1)} AS rating_bucket, CAST(sum(total_appointments) AS BIGINT) AS total_appointments, CAST(sum(no_show) AS BIGINT) AS no_shows, {rate('sum(no_show)', 'sum(total_appointments)')} AS no_show_rate FROM mart_appointment_quality WHERE avg_doctor_rating IS NOT NULL GROUP BY 1",
    "global_stats": f"SELECT count(*) AS n_rows, count(amount_cents) AS with_amount, min(appointment_date) AS first_date, max(appointment_date) AS last_date, CAST(sum(amount_cents) AS BIGINT) AS cents, {cut('avg(patient_age_at_appointment)', 4)} AS mean_age FROM fct_appointments",
    "having_volume": f"SELECT channel, specialty_id, country_id, count(*) AS total_appointments, {n("status = 'no_show'")} AS no_shows, {rate(n("status = 'no_show'"), 'count(*)')} AS no_show_rate FROM fct_appointments GROUP BY 1, 2, 3 HAVING count(*) >= 10 ORDER BY no_show_rate DESC, total_appointments DESC, channel, specialty_id NULLS FIRST, country_id NULLS FIRST LIMIT 30",
    "win_row_number": f"SELECT appointment_id, patient_id, row_number() OVER v AS visit_number FROM fct_appointments {_VISITS}",
    "win_rank_variants": "SELECT *, rank() OVER (PARTITION BY specialty_id ORDER BY visits DESC) AS rank_gaps, dense_rank() OVER (PARTITION BY specialty_id ORDER BY visits DESC) AS rank_dense, row_number() OVER (PARTITION BY specialty_id ORDER BY visits DESC, doctor_id) AS rank_row FROM (SELECT specialty_id, doctor_id, count(*) AS visits FROM fct_appointments GROUP BY 1, 2)",
    "win_ntile": "SELECT *, ntile(4) OVER (PARTITION BY country_id ORDER BY visits DESC, doctor_id) AS quartile FROM (SELECT country_id, doctor_id, count(*) AS visits FROM fct_appointments WHERE country_id IS NOT NULL GROUP BY 1, 2)",
    "win_lag_days": f"SELECT appointment_id, lag(appointment_date) OVER v AS previous_date, appointment_date - lag(appointment_date) OVER v AS days FROM fct_appointments {_VISITS}",
    "win_lead": f"SELECT appointment_id, lead(appointment_date) OVER v AS next_date, lead(status, 1, 'none') OVER v AS next_status FROM fct_appointments {_VISITS}",
    "win_first_last": "SELECT patient_id, arg_min(channel, (appointment_start_at, appointment_id)) AS first_channel, arg_max(channel, (appointment_start_at, appointment_id)) AS last_channel FROM fct_appointments GROUP BY 1",
    "win_running_rolling": f"SELECT payment_date, cents, CAST(sum(cents) OVER (ORDER BY payment_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(sum(cents) OVER (ORDER BY payment_date ROWS 6 PRECEDING) AS BIGINT) AS rolling_7 FROM (SELECT payment_date, CAST(sum(amount_cents) AS BIGINT) AS cents FROM fct_payments WHERE {PAID} GROUP BY 1)",
    "win_rolling_avg_spine": f"SELECT date, visits, {cut('avg(visits) OVER (ORDER BY date ROWS 6 PRECEDING)', 4)} AS mean_7 FROM (SELECT s.date, count(a.appointment_id) AS visits FROM ({_SPINE.format('(SELECT min(appointment_date) FROM fct_appointments)', '(SELECT max(appointment_date) FROM fct_appointments)', 'DAY')}) s LEFT JOIN fct_appointments a ON a.appointment_date = s.date GROUP BY 1)",
    "qualify_latest": f"SELECT patient_id, appointment_id, appointment_date FROM fct_appointments WHERE {DONE} QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY appointment_start_at DESC, appointment_id DESC) = 1",
    "qualify_top_per_group": f"SELECT * FROM ({_REVENUE}) QUALIFY rank() OVER (PARTITION BY specialty_id ORDER BY cents DESC) = 1",
    "qualify_nth": f"SELECT country_id, doctor_id, count(*) AS total_appointments FROM fct_appointments WHERE {DONE} GROUP BY 1, 2 QUALIFY dense_rank() OVER (PARTITION BY country_id ORDER BY count(*) DESC) = 2",
    "qualify_pk_duplicates": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1",
    "share_of_total": f"SELECT channel, count(*) AS appointments, CAST(sum(count(*)) OVER () AS BIGINT) AS total_appointments, {cut(div('(100 * count(*))', '(sum(count(*)) OVER ())'), 2)} AS pct_of_total FROM fct_appointments GROUP BY 1",
    "worst_channel": f"SELECT specialty_id, channel, count(*) AS total_appointments, {n("status = 'no_show'")} AS no_shows, {rate(n("status = 'no_show'"), 'count(*)')} AS no_show_rate FROM fct_appointments GROUP BY 1, 2 HAVING count(*) >= 10 QUALIFY rank() OVER (PARTITION BY specialty_id ORDER BY no_show_rate DESC) = 1",
    "mom_yoy_cumulative": f"SELECT month, {eur('c')} AS revenue_eur, {eur('lag(c) OVER w')} AS prev_month_revenue, {eur('lag(c, 12) OVER w')} AS same_month_last_year, {cut(div('(c - lag(c) OVER w)', '(lag(c) OVER w)'), 6)} AS mom_growth, {cut(div('(c - lag(c, 12) OVER w)', '(lag(c, 12) OVER w)'), 6)} AS yoy_growth, {eur('sum(c) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING)')} AS cumulative_revenue FROM (SELECT {PM} AS month, CAST(sum(amount_cents) AS BIGINT) AS c FROM fct_payments WHERE {PAID} GROUP BY 1) WINDOW w AS (ORDER BY month)",
    "mtd_qtd_ytd": f"SELECT {_since('month')} AS revenue_mtd, {_since('quarter')} AS revenue_qtd, {_since('year')} AS revenue_ytd, {eur('sum(amount_cents)')} AS revenue_all_time FROM fct_payments WHERE {PAID}",
    "channel_rates": f"SELECT {M} AS month, channel, count(*) AS total_appointments, " + ", ".join(f"{n(f"status = '{s}'")} AS {s}, {rate(n(f"status = '{s}'"), 'count(*)')} AS {s}_rate" for s in ("completed", "no_show", "cancelled")) + " FROM fct_appointments GROUP BY 1, 2",
    "ltv": f"SELECT patient_id, {eur('c')} AS ltv_eur, k AS total_appointments, life AS lifespan_months, {each('c', 'k')} AS avg_revenue_per_visit, {cut(div('k', 'life'), 2)} AS visits_per_month, ntile(5) OVER (ORDER BY c DESC NULLS LAST, patient_id) AS ltv_quintile FROM (SELECT a.patient_id, CAST(sum(y.amount_cents) AS BIGINT) AS c, count(DISTINCT a.appointment_id) AS k, date_diff('month', min(a.appointment_date), max(a.appointment_date)) AS life FROM fct_appointments a LEFT JOIN fct_payments y ON a.appointment_id = y.appointment_id AND y.{PAID} WHERE a.{DONE} GROUP BY 1)",
    "stage_funnel": f"SELECT month, l.k AS total_leads, coalesce(c.k, 0) AS converted_leads, coalesce(y.k, 0) AS paid_appointments, {rate('c.k', 'l.k')} AS lead_conversion_rate, {rate('y.k', 'c.k')} AS appt_to_payment_rate, {rate('y.k', 'l.k')} AS end_to_end_rate FROM (SELECT {MONTH.format('lead_date')} AS month, count(*) AS k FROM fct_leads GROUP BY 1) l LEFT JOIN (SELECT {MONTH.format('lead_date')} AS month, count(*) AS k FROM fct_leads WHERE is_converted_to_appointment GROUP BY 1) c USING (month) LEFT JOIN (SELECT {PM} AS month, count(*) AS k FROM fct_payments WHERE {PAID} GROUP BY 1) y USING (month)",
    "utilisation": f"SELECT {M} AS month, d.specialty_id, count(DISTINCT a.doctor_id) AS active_doctors, count(*) AS total_slots, {n('a.' + DONE)} AS completed_slots, {rate(n('a.' + DONE), 'count(*)')} AS utilisation_rate, {cut(div('count(*)', 'count(DISTINCT a.doctor_id)'), 1)} AS avg_appointments_per_doctor FROM fct_appointments a JOIN dim_doctors d ON a.doctor_id = d.doctor_id GROUP BY 1, 2",
    "supply_demand_active": f"SELECT d.month, specialty_id, country_id, s.active_doctors, d.appointments_requested, d.unique_patients, {cut(div('d.appointments_requested', 's.active_doctors'), 1)} AS demand_per_doctor FROM (SELECT {M} AS month, specialty_id, country_id, count(*) AS appointments_requested, count(DISTINCT patient_id) AS unique_patients FROM fct_appointments GROUP BY 1, 2, 3) d JOIN (SELECT specialty_id, country_id, count(DISTINCT doctor_id) AS active_doctors FROM dim_doctors WHERE is_active GROUP BY 1, 2) s USING (specialty_id, country_id)",
    "funnel_by_source": f"SELECT {MONTH.format('lead_date')} AS lead_month, lead_source, count(DISTINCT lead_id) AS total_leads, {n('is_converted_to_appointment')} AS to_appointment, {n('is_converted_to_payment')} AS to_payment, {rate(n('is_converted_to_appointment'), 'count(DISTINCT lead_id)')} AS lead_to_appt_rate, {rate(n('is_converted_to_payment'), n('is_converted_to_appointment'))} AS appt_to_payment_rate, {rate(n('is_converted_to_payment'), 'count(DISTINCT lead_id)')} AS end_to_end_rate FROM fct_leads WHERE lead_date < (SELECT {MONTH.format('max(lead_date)')} FROM fct_leads) GROUP BY 1, 2",
    "return_90d": f"SELECT {MONTH.format('first_date')} AS acquisition_month, count(*) AS new_patients, {n('second_date - first_date <= 90')} AS returned_in_90d, {rate(n('second_date - first_date <= 90'), 'count(*)')} AS return_rate FROM ({_NEXT}) GROUP BY 1",
    "recency_segments": _RECENCY,
    "segment_shares": f"SELECT patient_segment, count(*) AS patients, {cut(div('count(*)', '(sum(count(*)) OVER ())'), 6)} AS pct_of_total FROM ({_RECENCY}) GROUP BY 1",
    "cohort_retention_adhoc": "SELECT strftime(cohort_month, '%Y-%m') AS cohort, cohort_size, " + ", ".join(f"max({cut('retention_rate * 100', 1)}) FILTER (WHERE months_since_acquisition = {k}) AS m{k}_pct" for k in range(6)) + " FROM mart_patient_retention WHERE months_since_acquisition <= 5 GROUP BY 1, 2",
    "no_show_trend_3m": f"SELECT month, total_appointments, no_shows, {cut(div('no_shows', 'total_appointments'), 6)} AS no_show_rate, {cut('avg(' + div('no_shows', 'total_appointments') + ') OVER (ORDER BY month ROWS 2 PRECEDING)', 6)} AS no_show_rate_3m_avg FROM (SELECT {M} AS month, count(*) AS total_appointments, {n("status = 'no_show'")} AS no_shows FROM fct_appointments GROUP BY 1)",
    "booking_window": f"SELECT CASE WHEN d = 0 THEN 'same_day' WHEN d <= 3 THEN '1-3_days' WHEN d <= 7 THEN '4-7_days' WHEN d <= 14 THEN '8-14_days' ELSE '15+_days' END AS booking_window, count(*) AS appointments, {rate(n("status = 'no_show'"), 'count(*)')} AS no_show_rate FROM (SELECT status, appointment_date - CAST(appointment_created_at AS DATE) AS d FROM fct_appointments) GROUP BY 1",
    "mau": f"SELECT {M} AS month, count(DISTINCT patient_id) AS active_patients FROM fct_appointments WHERE {DONE} GROUP BY 1",
    "last12m_volume": f"SELECT {M} AS month, doctor_id, count(*) AS total_appointments, {n(DONE)} AS completed, {n("status = 'no_show'")} AS no_shows, {rate(n("status = 'no_show'"), 'count(*)')} AS no_show_rate FROM fct_appointments WHERE appointment_date >= CAST((SELECT max(appointment_date) FROM fct_appointments) - INTERVAL 12 MONTH AS DATE) GROUP BY 1, 2",
    "bi_revenue_mtd_mom": f"SELECT {eur('al')} AS revenue_total, {eur('now')} AS revenue_mtd, {eur('prev')} AS revenue_prev_month, {cut(div('(now - prev)', 'prev'), 6)} AS mom_pct, CASE WHEN now > prev AND prev <> 0 THEN 'up' WHEN now < prev THEN 'down' ELSE 'flat' END AS trend FROM (SELECT sum(amount_cents) AS al, coalesce(sum(amount_cents) FILTER (WHERE {PM} = m), 0) AS now, coalesce(sum(amount_cents) FILTER (WHERE {PM} = CAST(m - INTERVAL 1 MONTH AS DATE)), 0) AS prev FROM fct_payments, (SELECT {MONTH.format('max(payment_date)')} AS m FROM fct_payments WHERE {PAID}) WHERE {PAID})",
    "bi_revenue_ytd_yoy": f"SELECT {eur('now')} AS revenue_ytd, {eur('prev')} AS revenue_sply, {cut(div('(now - prev)', 'prev'), 6)} AS yoy_pct FROM (SELECT coalesce(sum(amount_cents) FILTER (WHERE year(payment_date) = year(a)), 0) AS now, coalesce(sum(amount_cents) FILTER (WHERE year(payment_date) = year(a) - 1 AND payment_date <= CAST(a - INTERVAL 12 MONTH AS DATE)), 0) AS prev FROM fct_payments, (SELECT max(payment_date) AS a FROM fct_payments WHERE {PAID}) WHERE {PAID})",
    "bi_weighted_rates": f"SELECT month, t AS total_appointments, c AS completed_appointments, f AS new_patients, {rate('c', 't')} AS completion_rate, {rate('s', 't')} AS no_show_rate, {rate('v', 'l')} AS lead_conversion, CASE WHEN {div('c', 't')} >= 0.75 THEN 'green' WHEN {div('c', 't')} >= 0.6 THEN 'amber' ELSE 'red' END AS completion_band, concat('Q', quarter(month)) AS quarter_label FROM (SELECT {MONTH.format('date')} AS month, CAST(sum(total_appointments) AS BIGINT) AS t, CAST(sum(completed_appointments) AS BIGINT) AS c, CAST(sum(no_show_appointments) AS BIGINT) AS s, CAST(sum(new_patient_appointments) AS BIGINT) AS f, CAST(sum(total_leads) AS BIGINT) AS l, CAST(sum(converted_leads) AS BIGINT) AS v FROM agg_daily_business_kpis GROUP BY 1)",
    "bi_specialty_table": _SPECIALTY,
    "bi_monthly_trend": f"SELECT strftime(date, '%Y-%m') AS month, CAST(sum(total_appointments) AS BIGINT) AS appointments, max(cumulative_appointments) AS cumulative, {cut('avg(completion_rate) * 100', 2)} AS mean_daily_completion_pct, CAST(sum(total_leads) AS BIGINT) AS leads FROM agg_daily_business_kpis GROUP BY 1",
    "bi_retention_mean_by_offset": f"SELECT months_since_acquisition, count(*) AS cohorts, {cut('avg(retention_rate)', 6)} AS mean_retention FROM mart_patient_retention WHERE months_since_acquisition BETWEEN 1 AND 12 GROUP BY 1",
    "bi_top10_specialties": f"SELECT * FROM ({_SPECIALTY}) ORDER BY revenue_eur DESC, specialty_name LIMIT 10",
    "bi_month_to_date_fixed": f"SELECT country_name, total_revenue_eur, {eur('sum(CAST(round(total_revenue_eur * 100) AS BIGINT)) OVER ()')} AS all_countries_eur, strftime(month, '%b %Y') AS label FROM agg_monthly_country_kpis WHERE month = (SELECT {MONTH.format('max(appointment_date)')} FROM fct_appointments)",
    "bi_retention_heatmap": "SELECT strftime(cohort_month, '%Y-%m') AS cohort, " + ", ".join(f"max({cut('retention_rate * 100', 1)}) FILTER (WHERE months_since_acquisition = {k}) AS m{k}_pct" for k in range(1, 13))
    + ", " + ", ".join(f"(SELECT {cut('avg(retention_rate) * 100', 1)} FROM mart_patient_retention WHERE months_since_acquisition = {k}) AS mean_m{k}_pct" for k in (1, 3)) + " FROM mart_patient_retention WHERE months_since_acquisition BETWEEN 1 AND 12 GROUP BY 1",
    "bi_revenue_vs_target": f"SELECT a.month, a.country_id, {eur('a.c')} AS revenue_eur, {cut(div('a.c * 10', 'b.c * 11') + ' - 1', 6)} AS vs_target FROM ({_COUNTRY_CENTS}) a LEFT JOIN ({_COUNTRY_CENTS}) b ON a.country_id = b.country_id AND a.month = b.month + INTERVAL 12 MONTH",
    "bi_month_labels": f"SELECT month, visits, strftime(month, '%b %Y') AS label, concat('Q', quarter(month), ' ', year(month)) AS quarter_label, month = max(month) OVER () AS is_current_month FROM (SELECT {M} AS month, count(*) AS visits FROM fct_appointments GROUP BY 1)",
    "kpi_last_7_days": "SELECT date, total_appointments, total_leads, completion_rate, cumulative_appointments FROM agg_daily_business_kpis ORDER BY date DESC LIMIT 7",
    "partition_rows": f"SELECT {M} AS month, count(*) AS n_rows FROM fct_appointments GROUP BY 1",
    "win_default_frame": "SELECT appointment_id, patient_id, appointment_date, count(*) OVER w AS visits_so_far, last_value(appointment_date) OVER w AS last_date FROM fct_appointments WINDOW w AS (PARTITION BY patient_id ORDER BY appointment_date)",
    "having_global": f"SELECT count(*) AS n_rows, {n('is_missing_payment')} AS missing_payments FROM fct_appointments HAVING {n('is_missing_payment')} > 0",
    "distinct_supply_cells": "SELECT DISTINCT specialty_id, country_id, is_active FROM dim_doctors",
    "text_functions": "SELECT doctor_id, upper(full_name) AS upper_name, lower(full_name) AS lower_name, full_name[1:5] AS first_five, full_name || ' (' || specialty_id || ')' AS label, pow(CAST(years_experience AS DOUBLE), 2) AS experience_squared, true AS blank_is_null FROM dim_doctors",
    "timestamp_functions": "SELECT appointment_id, epoch_ms(appointment_start_at) AS start_ms, true AS round_trip, strftime(appointment_start_at - INTERVAL 36 HOUR, '%Y-%m-%d %H:%M') AS start_minus_36h, appointment_date AS parsed, CAST(NULL AS DATE) AS not_parsed, appointment_start_at >= TIMESTAMP '1970-01-01' AS after_epoch FROM fct_appointments",
    "incremental_upsert": """
        WITH old AS (SELECT appointment_id, CASE WHEN appointment_id % 7 = 0 THEN 'scheduled' ELSE status END AS status, updated_at, appointment_date, patient_appointment_sequence FROM fct_appointments WHERE updated_at <= TIMESTAMP '1999-01-01'),
             new AS (SELECT appointment_id, status, CASE WHEN appointment_id % 7 = 0 THEN updated_at + INTERVAL 5000 DAY ELSE updated_at END AS updated_at, appointment_date, is_missing_payment, patient_appointment_sequence FROM fct_appointments),
             delta AS (SELECT * FROM new WHERE updated_at > (SELECT coalesce(max(updated_at), TIMESTAMP '1970-01-01') FROM old))
        SELECT appointment_id, status, updated_at, appointment_date, is_missing_payment, patient_appointment_sequence FROM delta
        UNION ALL SELECT appointment_id, status, updated_at, appointment_date, NULL, patient_appointment_sequence FROM old WHERE appointment_id NOT IN (SELECT appointment_id FROM delta)""",
    "dev_window_fact": "SELECT appointment_id, appointment_date, patient_appointment_sequence FROM fct_appointments WHERE appointment_date >= (SELECT max(appointment_date) FROM fct_appointments) - 90",
    "scd2_doctors": """
        WITH t0 AS (SELECT * FROM raw_doctors WHERE doctor_id % 13 <> 0), t1 AS (SELECT * REPLACE (CASE WHEN doctor_id % 3 = 0 THEN 5.0 ELSE rating END AS rating) FROM raw_doctors WHERE doctor_id % 11 <> 0),
             changed AS (SELECT t1.* FROM t1 LEFT JOIN t0 USING (doctor_id) WHERE t0.rating IS DISTINCT FROM t1.rating OR t0.doctor_id IS NULL)
        SELECT doctor_id, is_active, rating, years_experience, accepts_online_booking, '2000-01-01 00:00:00' AS valid_from, CASE WHEN doctor_id IN (SELECT doctor_id FROM changed) THEN '2000-02-01 00:00:00' END AS valid_to, doctor_id NOT IN (SELECT doctor_id FROM changed) AS is_current FROM t0
        UNION ALL SELECT doctor_id, is_active, rating, years_experience, accepts_online_booking, '2000-02-01 00:00:00', NULL, true FROM changed""",
    "scd2_patients": """
        WITH t0 AS (SELECT * REPLACE (CASE WHEN patient_id % 5 <> 0 THEN city END AS city) FROM raw_patients), t1 AS (SELECT * REPLACE (CASE WHEN patient_id % 10 = 0 THEN 'known now' ELSE city END AS city) FROM t0),
             changed AS (SELECT * FROM t1 WHERE patient_id % 17 = 0 OR patient_id % 10 = 0)
        SELECT patient_id, is_active, city, country_id, acquisition_channel, '2000-01-01 00:00:00' AS valid_from, CASE WHEN patient_id % 10 = 0 THEN '2000-02-01 00:00:00' END AS valid_to, patient_id % 10 <> 0 AS is_current FROM t0 WHERE patient_id % 17 <> 0
        UNION ALL SELECT patient_id, is_active, city, country_id, acquisition_channel, '2000-02-01 00:00:00', NULL, true FROM changed""",
}


def _test_sql(t) -> str:
    """Failing rows of a data test, counted."""
    if t.kind == "unique":
        return f"SELECT count(*) FROM (SELECT {t.column} FROM {t.model} WHERE {t.column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    if t.kind == "not_null":
        return f"SELECT count(*) - count({t.column}) FROM {t.model}"
    if t.kind == "relationships":
        return f"SELECT count(*) FROM {t.model} a WHERE {t.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {t.to} b WHERE b.{t.column} = a.{t.column})"
    if t.kind == "accepted_values":
        return f"SELECT count(DISTINCT {t.column}) FROM {t.model} WHERE {t.column} NOT IN ({', '.join(f"'{v}'" for v in t.values)})"
    if t.kind == "expression":
        return f"SELECT count(*) FROM {t.model} WHERE NOT ({t.expression})"
    return {
        "converted_lead_without_visit": "SELECT count(*) FROM fct_leads WHERE lead_status = 'converted' AND appointment_id IS NULL",
        "converted_lead_unknown_visit": "SELECT count(*) FROM fct_leads WHERE is_converted_to_appointment AND appointment_id NOT IN (SELECT appointment_id FROM fct_appointments)",
        "lead_country_differs": "SELECT count(*) FROM fct_leads l JOIN fct_appointments a ON l.appointment_id = a.appointment_id WHERE l.country_id <> a.country_id",
        "completed_without_payment": f"SELECT count(*) FROM fct_appointments WHERE {DONE} AND coalesce(payment_status, 'none') NOT IN ('paid', 'refunded')",
        "visit_in_the_future": f"SELECT count(*) FROM fct_appointments WHERE status <> 'scheduled' AND appointment_date > (SELECT max(appointment_date) FROM fct_appointments WHERE {DONE})",
        "negative_revenue": "SELECT count(*) FROM fct_payments WHERE amount_cents < 0",
    }[t.kind]


def _tests() -> dict[str, str]:
    from tidemark.plans.quality import TESTS

    out: dict[str, list[str]] = {}
    for t in TESTS:
        out.setdefault(f"dq_{t.kind}", []).append(f"""SELECT '{t.name.replace("'", "''")}' AS test, '{t.severity}' AS severity, ({_test_sql(t)}) AS failing_rows""")
    return {k: " UNION ALL ".join(v) for k, v in out.items()}


QUERY_SQL |= _tests()
QUERY_SQL["contract_core"] = " UNION ALL ".join(f"SELECT '{n}' AS model, CAST(0 AS BIGINT) AS violations" for n in ("dim_patients", "dim_doctors", "dim_specialties", "dim_countries", "fct_appointments", "fct_payments", "fct_leads"))
