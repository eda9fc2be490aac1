"""SQL of the models, over the raw tables."""


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0))"


def cut(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,12)), {places}) AS DOUBLE)"


def rate(a: str, b: str) -> str:
    return cut(div(a, b), 4)


def n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def cents(condition: str = "payment_status = 'paid'") -> str:
    return f"CAST(coalesce(sum(amount_cents) FILTER (WHERE {condition}), 0) AS BIGINT)"


def each(c: str, k: str) -> str:
    """Cents a head, half up, in euros."""
    return f"((2 * {c} + {k}) // NULLIF(2 * {k}, 0)) / 100.0::DOUBLE"


MONTH = "CAST(date_trunc('month', {}) AS DATE)"
_STATUS = {s: f"{n(f"status = '{s}'")} AS {s}_appointments" for s in ("completed", "cancelled", "no_show")}

MODEL_SQL = {
    "stg_appointments": "SELECT * REPLACE (lower(status) AS status, lower(channel) AS channel, NULLIF(cancellation_reason, '') AS cancellation_reason) FROM raw_appointments",
    "stg_countries": "SELECT country_id, country_name, region, currency FROM raw_countries",
    "stg_doctors": f"SELECT * REPLACE ({cut('rating', 2)} AS rating) FROM raw_doctors",
    "stg_leads": "SELECT * REPLACE (lower(lead_source) AS lead_source, lower(lead_status) AS lead_status) FROM raw_leads",
    "stg_patients": "SELECT * REPLACE (lower(acquisition_channel) AS acquisition_channel) FROM raw_patients",
    "stg_payments": "SELECT * REPLACE (upper(currency) AS currency, lower(payment_status) AS payment_status, lower(payment_method) AS payment_method) FROM raw_payments",
    "stg_specialties": "SELECT specialty_id, specialty_name, specialty_group FROM raw_specialties",
    "int_appointments_enriched": """
        SELECT a.*, d.specialty_id, d.country_id, d.rating AS doctor_rating,
               date_diff('year', p.birth_date, CAST(a.appointment_start_at AS DATE)) AS patient_age_at_appointment,
               y.amount_cents, y.payment_status, a.status = 'completed' AND y.appointment_id IS NULL AS is_missing_payment,
               row_number() OVER v AS patient_appointment_sequence,
               date_diff('day', CAST(lag(a.appointment_start_at) OVER v AS DATE), CAST(a.appointment_start_at AS DATE)) AS days_since_last_appointment
        FROM stg_appointments a LEFT JOIN stg_doctors d ON a.doctor_id = d.doctor_id LEFT JOIN stg_patients p ON a.patient_id = p.patient_id
             LEFT JOIN stg_payments y ON a.appointment_id = y.appointment_id
        WINDOW v AS (PARTITION BY a.patient_id ORDER BY a.appointment_start_at, a.appointment_id)""",
    "patient_counts": f"""
        SELECT patient_id AS pid, count(*) AS total_appointments, {_STATUS['completed']}, {_STATUS['cancelled']}, {_STATUS['no_show']},
               min(CAST(appointment_start_at AS DATE)) AS first_appointment_date, max(CAST(appointment_start_at AS DATE)) AS last_appointment_date,
               min(CAST(appointment_start_at AS DATE)) FILTER (WHERE status = 'completed') AS first_completed_appointment_date,
               {cents()} AS total_revenue_cents, count(DISTINCT specialty_id) AS distinct_specialties_consulted
        FROM int_appointments_enriched GROUP BY patient_id""",
    "int_patient_lifetime_metrics": f"""
        SELECT p.patient_id, p.acquisition_channel, p.country_id, c.* EXCLUDE (pid), {MONTH.format('first_completed_appointment_date')} AS cohort_month,
               date_diff('day', first_appointment_date, last_appointment_date) AS days_as_patient, {rate('no_show_appointments', 'total_appointments')} AS no_show_rate,
               {rate('cancelled_appointments', 'total_appointments')} AS cancellation_rate
        FROM stg_patients p LEFT JOIN patient_counts c ON p.patient_id = c.pid""",
    "doctor_counts": f"""
        SELECT doctor_id AS did, count(*) AS total_appointments, {_STATUS['completed']}, {_STATUS['cancelled']}, {_STATUS['no_show']}, {cents()} AS total_revenue_cents,
               count(DISTINCT patient_id) AS distinct_patients, count(DISTINCT {MONTH.format('appointment_start_at')}) AS active_months,
               min(CAST(appointment_start_at AS DATE)) AS first_appointment_date, max(CAST(appointment_start_at AS DATE)) AS last_appointment_date
        FROM int_appointments_enriched GROUP BY doctor_id""",
    "int_doctor_performance": f"""
        SELECT d.doctor_id, d.specialty_id, d.country_id, d.rating, d.years_experience, d.accepts_online_booking, d.is_active, c.* EXCLUDE (did),
               {rate('no_show_appointments', 'total_appointments')} AS no_show_rate, {rate('completed_appointments', 'total_appointments')} AS completion_rate,
               rank() OVER (PARTITION BY d.specialty_id ORDER BY total_revenue_cents DESC NULLS LAST) AS revenue_rank_in_specialty
        FROM stg_doctors d LEFT JOIN doctor_counts c ON d.doctor_id = c.did""",
    "int_lead_to_appointment_funnel": """
        SELECT l.lead_id, l.patient_id, l.specialty_id, l.country_id, l.lead_source, l.lead_status, l.created_at AS lead_created_at, a.appointment_id, a.appointment_created_at,
               a.status AS appointment_status, y.payment_created_at, y.amount_cents, y.payment_status, a.appointment_id IS NOT NULL AS is_converted_to_appointment,
               y.appointment_id IS NOT NULL AS is_converted_to_payment, date_diff('day', CAST(l.created_at AS DATE), CAST(a.appointment_start_at AS DATE)) AS days_lead_to_appointment,
               date_diff('day', CAST(a.appointment_created_at AS DATE), CAST(y.payment_created_at AS DATE)) AS days_appointment_to_payment
        FROM stg_leads l LEFT JOIN stg_appointments a ON l.converted_appointment_id = a.appointment_id
             LEFT JOIN stg_payments y ON a.appointment_id = y.appointment_id AND y.payment_status = 'paid'""",
    "dim_patients": """
        SELECT p.patient_id, p.full_name, p.gender, p.birth_date, date_diff('year', p.birth_date, (SELECT max(CAST(appointment_start_at AS DATE)) FROM stg_appointments WHERE status = 'completed')) AS current_age,
               p.country_id, p.city, p.created_at, p.acquisition_channel, p.is_active, coalesce(m.total_appointments, 0) AS total_appointments,
               coalesce(m.completed_appointments, 0) AS completed_appointments, coalesce(m.total_revenue_cents, 0) AS total_revenue_cents, coalesce(m.total_revenue_cents, 0) / 100.0::DOUBLE AS total_revenue_eur,
               m.first_appointment_date, m.last_appointment_date, m.cohort_month, m.no_show_rate, m.cancellation_rate,
               CASE WHEN coalesce(m.completed_appointments, 0) = 0 THEN 'new' WHEN m.completed_appointments < 3 THEN 'active' WHEN m.completed_appointments < 7 THEN 'loyal' ELSE 'champion' END AS patient_segment
        FROM stg_patients p LEFT JOIN int_patient_lifetime_metrics m ON p.patient_id = m.patient_id""",
    "dim_doctors": """
        SELECT d.*, coalesce(m.total_appointments, 0) AS total_appointments, coalesce(m.completed_appointments, 0) AS completed_appointments, coalesce(m.total_revenue_cents, 0) AS total_revenue_cents,
               coalesce(m.total_revenue_cents, 0) / 100.0::DOUBLE AS total_revenue_eur, m.no_show_rate, m.completion_rate, m.distinct_patients, m.revenue_rank_in_specialty, m.first_appointment_date, m.last_appointment_date
        FROM stg_doctors d LEFT JOIN int_doctor_performance m ON d.doctor_id = m.doctor_id""",
    "dim_specialties": "SELECT * FROM stg_specialties",
    "dim_countries": "SELECT * FROM stg_countries",
    "fct_appointments": "SELECT *, CAST(appointment_start_at AS DATE) AS appointment_date, amount_cents / 100.0::DOUBLE AS amount_eur FROM int_appointments_enriched",
    "fct_payments": """
        SELECT y.*, d.specialty_id, d.country_id, CAST(y.payment_created_at AS DATE) AS payment_date, y.amount_cents / 100.0::DOUBLE AS amount_eur
        FROM stg_payments y LEFT JOIN stg_doctors d ON y.doctor_id = d.doctor_id""",
    "fct_leads": "SELECT *, CAST(lead_created_at AS DATE) AS lead_date, amount_cents / 100.0::DOUBLE AS amount_eur FROM int_lead_to_appointment_funnel",
    "mart_patient_retention": f"""
        SELECT cohort_month, months_since_acquisition, retained_patients, cohort_size, {rate('retained_patients', 'cohort_size')} AS retention_rate
        FROM (SELECT p.cohort_month, date_diff('month', p.cohort_month, {MONTH.format('a.appointment_date')}) AS months_since_acquisition, count(DISTINCT a.patient_id) AS retained_patients
              FROM int_patient_lifetime_metrics p JOIN fct_appointments a ON p.patient_id = a.patient_id AND a.status = 'completed' WHERE p.cohort_month IS NOT NULL GROUP BY 1, 2) r
        JOIN (SELECT cohort_month, count(*) AS cohort_size FROM int_patient_lifetime_metrics WHERE cohort_month IS NOT NULL GROUP BY 1) s USING (cohort_month)""",
    "mart_doctor_supply_demand": f"""
        SELECT a.*, s.total_active_doctors, s.avg_doctor_rating, s.avg_years_experience, {cut(div('a.total_appointments', 's.total_active_doctors'), 2)} AS appointments_per_doctor,
               {rate('a.no_show_appointments', 'a.total_appointments')} AS no_show_rate
        FROM (SELECT specialty_id, country_id, {MONTH.format('appointment_date')} AS month, count(*) AS total_appointments, {_STATUS['completed']}, {_STATUS['no_show']},
                     count(DISTINCT doctor_id) AS active_doctors_with_appointments FROM fct_appointments GROUP BY 1, 2, 3) a
        LEFT JOIN (SELECT specialty_id, country_id, {n('is_active')} AS total_active_doctors, {cut('avg(rating)', 2)} AS avg_doctor_rating, {cut('avg(years_experience)', 1)} AS avg_years_experience
                   FROM dim_doctors GROUP BY 1, 2) s ON a.specialty_id = s.specialty_id AND a.country_id = s.country_id""",
    "mart_appointment_quality": f"""
        SELECT {MONTH.format('appointment_date')} AS month, channel, specialty_id, country_id, count(*) AS total_appointments, {n("status = 'completed'")} AS completed, {n("status = 'cancelled'")} AS cancelled,
               {n("status = 'no_show'")} AS no_show, {n("status = 'scheduled'")} AS scheduled, {cut('avg(doctor_rating)', 2)} AS avg_doctor_rating, {rate(n("status = 'completed'"), 'count(*)')} AS completion_rate,
               {rate(n("status = 'no_show'"), 'count(*)')} AS no_show_rate, {rate(n("status = 'cancelled'"), 'count(*)')} AS cancellation_rate
        FROM fct_appointments GROUP BY 1, 2, 3, 4""",
    "agg_daily_business_kpis": f"""
        SELECT * EXCLUDE (c) FROM (
          SELECT d.*, c / 100.0::DOUBLE AS daily_revenue_eur, {rate('completed_appointments', 'total_appointments')} AS completion_rate, {rate('converted_leads', 'total_leads')} AS lead_conversion_rate,
                 CAST(sum(c) OVER (ORDER BY date NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) / 100.0::DOUBLE AS cumulative_revenue_eur,
                 CAST(sum(total_appointments) OVER (ORDER BY date NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_appointments
          FROM (SELECT date, coalesce(total_appointments, 0) AS total_appointments, coalesce(completed_appointments, 0) AS completed_appointments, coalesce(no_show_appointments, 0) AS no_show_appointments,
                       coalesce(new_patient_appointments, 0) AS new_patient_appointments, coalesce(c, 0) AS c, coalesce(paid_payments, 0) AS paid_payments, coalesce(refunded_payments, 0) AS refunded_payments,
                       coalesce(total_leads, 0) AS total_leads, coalesce(converted_leads, 0) AS converted_leads
                FROM (SELECT appointment_date AS date, count(*) AS total_appointments, {_STATUS['completed']}, {_STATUS['no_show']}, {n('is_first_appointment')} AS new_patient_appointments FROM fct_appointments GROUP BY 1) a
                FULL JOIN (SELECT payment_date AS date, {cents()} AS c, {n("payment_status = 'paid'")} AS paid_payments, {n("payment_status = 'refunded'")} AS refunded_payments FROM fct_payments GROUP BY 1) y USING (date)
                FULL JOIN (SELECT lead_date AS date, count(*) AS total_leads, {n('is_converted_to_appointment')} AS converted_leads FROM fct_leads GROUP BY 1) l USING (date)) d) t
        WHERE total_appointments > 0""",
    "monthly_country": f"""
        SELECT {MONTH.format('appointment_date')} AS month, country_id, count(*) AS total_appointments, {_STATUS['completed']}, {_STATUS['no_show']}, count(DISTINCT patient_id) AS unique_patients,
               count(DISTINCT doctor_id) AS active_doctors FROM fct_appointments GROUP BY 1, 2""",
    "agg_monthly_country_kpis": f"""
        SELECT a.*, c.country_name, c.region, coalesce(r.c, 0) / 100.0::DOUBLE AS total_revenue_eur, {rate('a.completed_appointments', 'a.total_appointments')} AS completion_rate,
               {each('coalesce(r.c, 0)', 'a.unique_patients')} AS revenue_per_patient, rank() OVER (PARTITION BY a.month ORDER BY coalesce(r.c, 0) DESC) AS country_revenue_rank
        FROM monthly_country a
        LEFT JOIN (SELECT {MONTH.format('payment_date')} AS month, country_id, CAST(sum(amount_cents) AS BIGINT) AS c FROM fct_payments WHERE payment_status = 'paid' GROUP BY 1, 2) r ON a.month = r.month AND a.country_id = r.country_id
        LEFT JOIN dim_countries c ON a.country_id = c.country_id""",
    "agg_specialty_performance": f"""
        SELECT a.* EXCLUDE (c), s.specialty_name, s.specialty_group, a.c / 100.0::DOUBLE AS total_revenue_eur, {rate('a.completed_appointments', 'a.total_appointments')} AS completion_rate,
               {cut(div('a.total_appointments', 'a.active_doctors'), 2)} AS appointments_per_doctor, rank() OVER (PARTITION BY a.month ORDER BY a.c DESC) AS specialty_revenue_rank
        FROM (SELECT {MONTH.format('appointment_date')} AS month, specialty_id, count(*) AS total_appointments, {_STATUS['completed']}, {_STATUS['no_show']}, count(DISTINCT patient_id) AS unique_patients,
                     count(DISTINCT doctor_id) AS active_doctors, {cents()} AS c FROM fct_appointments GROUP BY 1, 2) a
        LEFT JOIN dim_specialties s ON a.specialty_id = s.specialty_id""",
}
