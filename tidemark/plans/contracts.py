"""Contracts of the core models: the columns and types that a build has to give."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the core models with their types, in DDL. Ids have the types of the raw tables.
CONTRACTS = {
    "dim_patients": "patient_id bigint, full_name string, gender string, birth_date date, current_age bigint, country_id bigint, city string, created_at date, acquisition_channel string, is_active boolean, total_appointments bigint, completed_appointments bigint, total_revenue_cents bigint, total_revenue_eur double, first_appointment_date date, last_appointment_date date, cohort_month date, no_show_rate double, cancellation_rate double, patient_segment string",
    "dim_doctors": "doctor_id bigint, full_name string, specialty_id string, country_id bigint, city string, created_at date, is_active boolean, rating double, years_experience bigint, accepts_online_booking boolean, total_appointments bigint, completed_appointments bigint, total_revenue_cents bigint, total_revenue_eur double, no_show_rate double, completion_rate double, distinct_patients bigint, revenue_rank_in_specialty bigint, first_appointment_date date, last_appointment_date date",
    "dim_specialties": "specialty_id string, specialty_name string, specialty_group string",
    "dim_countries": "country_id bigint, country_name string, region string, currency string",
    "fct_appointments": "appointment_id bigint, patient_id bigint, doctor_id bigint, appointment_created_at timestamp_ntz, appointment_start_at timestamp_ntz, updated_at timestamp_ntz, status string, channel string, cancellation_reason string, is_first_appointment boolean, specialty_id string, country_id bigint, doctor_rating double, patient_age_at_appointment bigint, amount_cents bigint, payment_status string, is_missing_payment boolean, patient_appointment_sequence bigint, days_since_last_appointment bigint, appointment_date date, amount_eur double",
    "fct_payments": "doctor_id bigint, payment_id bigint, appointment_id bigint, patient_id bigint, payment_created_at timestamp_ntz, updated_at timestamp_ntz, amount_cents bigint, currency string, payment_status string, payment_method string, specialty_id string, country_id bigint, payment_date date, amount_eur double",
    "fct_leads": "lead_id bigint, patient_id bigint, specialty_id string, country_id bigint, lead_source string, lead_status string, lead_created_at timestamp_ntz, appointment_id bigint, appointment_created_at timestamp_ntz, appointment_status string, payment_created_at timestamp_ntz, amount_cents bigint, payment_status string, is_converted_to_appointment boolean, is_converted_to_payment boolean, days_lead_to_appointment bigint, days_appointment_to_payment bigint, lead_date date, amount_eur double",
}


def contract(model: str) -> T.StructType:
    return T.StructType.fromDDL(CONTRACTS[model])
