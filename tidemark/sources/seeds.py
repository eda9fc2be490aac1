"""Small reference tables that are kept with the code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The countries of the marketplace.
_COUNTRIES = (
    ("ES", "España", "Europa", "EUR", "es", "Europe/Madrid"),
    ("GB", "Reino Unido", "Europa", "GBP", "en", "Europe/London"),
    ("IT", "Italia", "Europa", "EUR", "it", "Europe/Rome"),
    ("DE", "Alemania", "Europa", "EUR", "de", "Europe/Berlin"),
    ("FR", "Francia", "Europa", "EUR", "fr", "Europe/Paris"),
    ("MX", "México", "Latinoamérica", "MXN", "es", "America/Mexico_City"),
    ("CO", "Colombia", "Latinoamérica", "COP", "es", "America/Bogota"),
    ("PT", "Portugal", "Europa", "EUR", "pt", "Europe/Lisbon"),
)

SEEDS = {"country_region_mapping": (_COUNTRIES, "country_id string, country_name string, region string, currency string, language string, timezone string")}


def seed(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = SEEDS[name]
    return spark.createDataFrame(list(rows), schema)


def load_seeds(spark: SparkSession, folder: str) -> dict[str, str]:
    """Writes every seed under folder, replacing what is there; paths by seed."""
    out = {name: f"{folder}/{name}" for name in SEEDS}
    for name, path in out.items():
        seed(spark, name).coalesce(1).write.mode("overwrite").parquet(path)
    return out
