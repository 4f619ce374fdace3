"""Small operators around names: unique cars, word lists, limits, and the price of points along a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unique_name, words
from .prices import PRICES, latest
from .spatial import point_countries, point_distances, unsized


def unique_cars(cars: DataFrame) -> DataFrame:
    """One row for each brand and unique name (model and year, or model and description where there is no year): of several
    the one with the least id."""
    key = F.coalesce(F.when(F.col("year").isNotNull(), unique_name(F.col("name"), F.col("year"))), unique_name(F.col("name"), F.col("description")))
    keyed = cars.withColumn("unique_name", key)
    first = F.row_number().over(Window.partitionBy("brand", "unique_name").orderBy("car_id"))
    return keyed.withColumn("_rank", first).filter("_rank = 1").drop("_rank")


def in_word_list(rows: DataFrame, column: str, word_list: DataFrame) -> DataFrame:
    """Rows one of whose words is in the list (word)."""
    keyed = rows.withColumn("_key", F.xxhash64(F.col(column)))
    met = keyed.select("_key", F.explode(F.array_distinct(words(F.col(column)))).alias("word")).join(word_list.select(F.lower("word").alias("word")), "word", "left_semi")
    return keyed.join(met.select("_key").distinct(), "_key", "left_semi").drop("_key")


def top_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group in a stated order: the limits on classes, sentences and brands."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def point_prices(points: DataFrame, countries: DataFrame, prices: DataFrame, general: DataFrame, litres_per_km: float, fuel: str) -> DataFrame:
    """points (route, seq, x, y) with the metres to the one before, the latest price where they are (at sea or without a price
    that for all) and what the way to them costs with tax."""
    far = point_distances(points).withColumn("point_id", F.struct("route", "seq"))
    where = point_countries(far.select("point_id", "x", "y"), countries).groupBy("point_id").agg(F.min("country").alias("country"))
    everywhere = latest(general).select(*[F.col(c).alias(f"g_{c}") for c in PRICES])
    out = far.join(unsized(where), "point_id", "left").join(latest(prices, "country").drop("date"), "country", "left").join(F.broadcast(everywhere), F.lit(True), "left")  # one row
    side = "euro" if fuel == "gasoline" else "diesel"
    price = F.coalesce(F.col(f"{side}_ttc"), F.col(f"g_{side}_ttc"))
    return out.select("route", "seq", "country", "meters", price.alias("price"), (F.col("meters") / 1000 * litres_per_km * price).alias("cost"))
