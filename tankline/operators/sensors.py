"""Sensors, their tracks and their dictionary: joins, roll-ups and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded


def with_statistics(sensors: DataFrame, stats: DataFrame) -> DataFrame:
    """Sensors left-joined with their statistics, one row each and one for a sensor without."""
    return sensors.join(stats, "sensor_id", "left")


def match_counts(joined: DataFrame) -> DataFrame:
    """How many sensors of with_statistics have statistics, and how many have none."""
    each = joined.groupBy("sensor_id").agg(F.max(F.col("phenomenon").isNotNull()).alias("has"))
    return each.agg(F.count_if("has").alias("matched"), F.count_if(~F.col("has")).alias("missing"))


def track_rollup(sensors: DataFrame, tracks: DataFrame) -> DataFrame:
    """Sensors with the number and total length of their tracks; a track without length counts as zero. The lengths are
    summed before the join, on the map side first, so a sensor with a third of all tracks is one row."""
    sums = tracks.groupBy("sensor_id").agg(F.count("*").alias("numb_tracks"), F.sum(F.coalesce("track_length", F.lit(0.0))).alias("total_length"))
    return sensors.join(sums, "sensor_id", "left").select(*sensors.columns, F.coalesce("numb_tracks", F.lit(0)).alias("numb_tracks"), F.coalesce("total_length", F.lit(0.0)).alias("total_length"))


def repaired_tracks(tracks: DataFrame, sensors: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tracks whose sensor isn't known get the real id that aliases (sensor_id, real_id) has for it, if any; repaired says
    whether. All other columns stay."""
    known = sensors.select("sensor_id", F.lit(True).alias("_known")).distinct()
    real = aliases.select("sensor_id", "real_id").dropDuplicates(["sensor_id"])
    joined = tracks.join(known, "sensor_id", "left").join(real, "sensor_id", "left")
    lost = F.col("_known").isNull() & F.col("real_id").isNotNull()
    return joined.select(*[F.when(lost, F.col("real_id")).otherwise(F.col(c)).alias(c) if c == "sensor_id" else F.col(c) for c in tracks.columns], lost.alias("repaired"))


def rewritten(sensors: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(manufacturer, model) by a vehicle dictionary (raw, brand, name): looked up by the brand, then by brand and model,
    then by the model; what isn't there stays."""
    words = vehicles.select(folded(F.col("raw")).alias("raw"), F.col("brand").alias("d_brand"), F.col("name").alias("d_name")).dropDuplicates(["raw"])
    out = sensors
    ways = {"m": folded(F.col("manufacturer")), "b": folded(F.concat_ws(" ", "manufacturer", "model")), "n": folded(F.col("model"))}
    for k, key in ways.items():
        side = words.select(F.col("raw").alias(f"_{k}"), F.col("d_brand").alias(f"_brand_{k}"), F.col("d_name").alias(f"_name_{k}"))
        out = out.join(side, key == F.col(f"_{k}"), "left")
    brand, name = (F.coalesce(*[F.col(f"_{x}_{k}") for k in ways]) for x in ("brand", "name"))
    return out.withColumns({"manufacturer": F.coalesce(brand, F.col("manufacturer")), "model": F.coalesce(name, F.col("model"))}).select(*sensors.columns)
