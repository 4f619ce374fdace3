"""Weighted consumption and emission statistics of sensors and register cars, by class, manufacturer and fuel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import clamped
from ..functions.text import folded, fuel_type

# The measures of a register car that statistics are made of, and those that costs need.
ALL_MEASURES = (
    "e_consumption_miles_per_kWh", "e_consumption_wh_per_km", "maximum_range_km", "maximum_range_miles", "metric_urban_cold", "metric_extra_urban", "metric_combined", "co2_g_per_km",
    "noise_level_dB_a_", "emissions_co_mg_per_km", "thc_emissions_mg_per_km", "emissions_nox_mg_per_km", "thc_plus_nox_emissions_mg_per_km", "particulates_no_mg_per_km", "rde_nox_urban", "rde_nox_combined",
)
REGISTER_MEASURES = ("metric_combined", "co2_g_per_km", "emissions_co_mg_per_km", "emissions_nox_mg_per_km", "thc_emissions_mg_per_km")
MIN_SUPPORT = 1500
MIN_PHENOMENA = 3


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null where the weights add up to zero."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def with_fuel(sensors: DataFrame) -> DataFrame:
    """sensors with the canonical fuel_type of fuel_raw."""
    return sensors.withColumn("fuel_type", fuel_type(F.col("fuel_raw")))


def vehicle_type_averages(sensors: DataFrame, stats: DataFrame) -> DataFrame:
    """Weighted means of max, avg and min, the latter clamped at zero first, by (vehicle_type, fuel_type, phenomenon);
    weights are measurement counts. numb_sensors counts all sensors of the fuel, with statistics or without."""
    known = with_fuel(sensors).select("sensor_id", F.col("sensor_type").alias("vehicle_type"), "fuel_type")
    w = F.col("numb_measurements")
    means = (
        stats.join(known, "sensor_id").groupBy("vehicle_type", "fuel_type", "phenomenon")
        .agg(weighted_mean(F.col("max"), w).alias("max"), weighted_mean(F.col("avg"), w).alias("average"), weighted_mean(clamped(F.col("min")), w).alias("min"), F.sum(w).alias("measurements"))
    )
    counts = known.groupBy("fuel_type").agg(F.count("*").alias("numb_sensors"))
    return means.join(counts, "fuel_type")


def manufacturer_averages(sensors: DataFrame, stats: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """The same by manufacturer too, whatever its case; groups with weights under min_support go. Sensors count where
    they have statistics."""
    known = with_fuel(sensors).select("sensor_id", F.col("sensor_type").alias("vehicle_type"), "fuel_type", folded(F.col("manufacturer_raw")).alias("manufacturer"))
    w, joined = F.col("numb_measurements"), stats.join(known, "sensor_id")
    means = joined.groupBy("manufacturer", "vehicle_type", "fuel_type", "phenomenon").agg(
        weighted_mean(F.col("max"), w).alias("max"), weighted_mean(F.col("avg"), w).alias("average"), weighted_mean(clamped(F.col("min")), w).alias("min"),
        F.sum(w).alias("measurements"), F.countDistinct("sensor_id").alias("numb_sensors"),
    )
    return means.filter(F.col("measurements") >= min_support)


def matched_categories(things: DataFrame, wiki: DataFrame, *columns: str, each_match: bool = False) -> DataFrame:
    """The columns of things with the category of each car page that wiki_hashes names; once for each category, or with
    each_match once for each page. The matches are exploded and met by hash, so nothing depends on their number."""
    rows = things.select(*columns, F.explode("wiki_hashes").alias("hash_id")).join(wiki.select("hash_id", "category"), "hash_id").select(*columns, "category")
    return rows if each_match else rows.distinct()


def category_averages(sensors: DataFrame, stats: DataFrame, wiki: DataFrame) -> DataFrame:
    """Weighted means by (category, fuel_type, phenomenon): a sensor counts once in a category; the min of CO2 and Speed is
    clamped first, and every mean min after."""
    members = matched_categories(with_fuel(sensors), wiki, "sensor_id", "fuel_type")
    w = F.col("numb_measurements")
    low = F.when(F.col("phenomenon").isin("CO2", "Speed"), clamped(F.col("min"))).otherwise(F.col("min"))
    return members.join(stats, "sensor_id").groupBy("category", "fuel_type", "phenomenon").agg(
        weighted_mean(F.col("max"), w).alias("max"), weighted_mean(F.col("avg"), w).alias("average"), clamped(weighted_mean(low, w)).alias("min"),
        F.sum(w).alias("measurements"), F.countDistinct("sensor_id").alias("numb_sensors"),
    )


def measures_of(cars: DataFrame) -> tuple[str, ...]:
    """The measures that cars has columns for."""
    return tuple(m for m in ALL_MEASURES if m in cars.columns)


def with_units(stats: DataFrame, phenomena: DataFrame) -> DataFrame:
    """stats with the unit of each phenomenon (name, unit); those of unknown phenomena go."""
    return stats.join(phenomena.select(F.col("name").alias("phenomenon"), "unit").distinct(), "phenomenon")


def register_averages(cars: DataFrame, wiki: DataFrame, measures: tuple[str, ...] | None = None) -> DataFrame:
    """The mean and number of positive values by (category, year, fuel_type, phenomenon), for measures, or all that cars
    has; a car counts once for each match.

    Columns become rows after a partial sum, by position, so that no car is repeated for each measure in the shuffle.
    """
    measures = measures_of(cars) if measures is None else measures
    members = matched_categories(cars, wiki, "year", "fuel_type", *measures, each_match=True)
    sums = [F.sum(F.when(F.col(m) > 0, F.col(m))).alias(f"{m}__sum") for m in measures] + [F.count_if(F.col(m) > 0).alias(f"{m}__n") for m in measures]
    wide = members.groupBy("category", "year", "fuel_type").agg(*sums)
    long = wide.select("category", "year", "fuel_type", F.inline(F.array(*[F.struct(F.lit(m).alias("phenomenon"), F.col(f"{m}__sum").alias("s"), F.col(f"{m}__n").alias("numb_cars")) for m in measures])))
    return long.filter("numb_cars > 0").select("category", "year", "fuel_type", "phenomenon", (F.col("s") / F.col("numb_cars")).alias("value"), "numb_cars")


def unpivot_measures(cars: DataFrame, *keys: str, measures: tuple[str, ...] | None = None) -> DataFrame:
    """A row (keys, phenomenon, value) for each positive measure of each car."""
    return cars.unpivot(list(keys), list(measures_of(cars) if measures is None else measures), "phenomenon", "value").filter("value > 0")


def sensor_fuel_models(category_stats: DataFrame) -> DataFrame:
    """One row per (category, fuel_type) with the mean speeds, consumptions and CO2; only where three phenomena or more are
    known. The parabola's points are (0, min), (mean speed, average), (max speed, max)."""
    usable = category_stats.filter(F.col("phenomenon").isin("Speed", "Consumption", "CO2"))
    pick = lambda p, c: F.max(F.when(F.col("phenomenon") == p, F.col(c)))
    names = {"Speed": "speed", "Consumption": "cons", "CO2": "co2"}
    values = [pick(p, c).alias(f"{short}_{c}") for p, short in names.items() for c in ("min", "average", "max")]
    return (
        usable.groupBy("category", "fuel_type")
        .agg(*values, pick("Speed", "measurements").alias("measurements"), pick("Speed", "numb_sensors").alias("numb_sensors"), F.countDistinct("phenomenon").alias("known"))
        .filter(F.col("known") >= MIN_PHENOMENA).drop("known")
    )


def register_models(register_stats: DataFrame, min_year: int | None = None) -> DataFrame:
    """One row per (category, fuel_type): for each measure the plain mean over years, from min_year on, and cars."""
    known = register_stats if min_year is None else register_stats.filter(F.col("year") >= min_year)
    values = []
    for m in REGISTER_MEASURES:
        of = F.col("phenomenon") == m
        values += [F.avg(F.when(of, F.col("value"))).alias(m), F.sum(F.when(of, F.col("numb_cars"))).alias(f"n_{m}")]
    return known.groupBy("category", "fuel_type").agg(*values)


def reported_cars(n_columns: list[Column]) -> Column:
    """The number of cars a result rests on: the mean of its pollutants' counts, rounded half to even."""
    return F.bround(sum(n_columns[1:], n_columns[0]) / len(n_columns), 0).cast("long")


def statistics_from_measurements(measurements: DataFrame, *keys: str) -> DataFrame:
    """Max, avg, min and counts by keys and phenomenon from raw measurements."""
    return measurements.groupBy(*keys, "phenomenon").agg(
        F.max("phenomenon_value").alias("max"), F.avg("phenomenon_value").alias("avg"), F.min("phenomenon_value").alias("min"),
        F.count("*").alias("numb_measurements"), F.countDistinct("track_id").alias("numb_tracks"), F.countDistinct("sensor_id").alias("numb_sensors"),
    )
