"""Table loads: one projection with its key for each stored table, dispatched by the kind of data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import clamped
from .readers import with_key
from .sinks import blanks_as_zero, floats_only

STATISTIC = ("max", "avg", "min", "numb_measurements", "numb_tracks", "numb_users", "numb_sensors")


def _present(df: DataFrame, *columns: str) -> list:
    return [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns]


def _statistic(key: str):
    def load(df: DataFrame) -> DataFrame:
        rows = df.select(key, "phenomenon", *_present(df, *STATISTIC)).withColumn("min", clamped(F.col("min")))
        return with_key(rows, "hash_id", key, "phenomenon")

    return load


#: For each kind its load; each takes the cleaned rows and returns those of the stored table.
LOADS = {
    "sensor": lambda df: df.select("sensor_id", "sensor_type", "manufacturer", "model", "fuel_type", *_present(df, "construction_year", "wiki_hashes")),
    "sensor_statistic": _statistic("sensor_id"),
    "track": lambda df: df.select("track_id", "sensor_id", F.coalesce("track_length", F.lit(0.0)).alias("track_length")),
    "track_statistic": _statistic("track_id"),
    "track_measurement": lambda df: with_key(df.select("track_measurement_id", "track_id", "sensor_id", "phenomenon", "phenomenon_value", "date"), "hash_id", "track_measurement_id", "phenomenon"),
    "wiki_car": lambda df: with_key(df.select("wiki_name", "category", "brand_name", "car_name", *_present(df, "page_id", "page_language")), "hash_id", "wiki_name", "category", "page_language"),
    "register_car": lambda df: with_key(floats_only(df, *[c for c in ("metric_combined", "co2_g_per_km", "emissions_co_mg_per_km", "emissions_nox_mg_per_km", "thc_emissions_mg_per_km") if c in df.columns]), "hash_id", "manufacturer", "model", "description", "fuel_type", "year"),
    "country": lambda df: df.select("country_alpha_2", "name", "country_alpha_3", *_present(df, "country_numeric", "currency_code", "currency_name", "polygons")),
    "country_price": lambda df: with_key(blanks_as_zero(df, "euro_ttc", "euro_ht", "diesel_ttc", "diesel_ht"), "hash_id", "country", "date"),
    "general_price": lambda df: blanks_as_zero(df, "euro_ttc", "euro_ht", "diesel_ttc", "diesel_ht"),
    "manufacturer_average": lambda df: with_key(df, "hash_id", "manufacturer", "vehicle_type", "fuel_type", "phenomenon"),
    "category_average": lambda df: with_key(df, "hash_id", "category", "fuel_type", "phenomenon"),
    "vehicle_type_average": lambda df: with_key(df, "hash_id", "vehicle_type", "fuel_type", "phenomenon"),
    "register_average": lambda df: with_key(df, "hash_id", "category", "year", "fuel_type", "phenomenon"),
}


def load(kind: str, rows: DataFrame) -> DataFrame:
    return LOADS[kind](rows)
