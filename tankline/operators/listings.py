"""Listings and reports: brands, cars, ids, categories, and counts of matches, classes and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_model, folded, stripped
from .statistics import matched_categories, weighted_mean

ALLOWED_FUELS = ("gasoline", "diesel")


def brands(*sources: DataFrame) -> DataFrame:
    """The distinct brands (column brand) of all sources, sorted; null and empty ones aren't brands."""
    rows = [s.select(stripped(F.col("brand")).alias("brand")) for s in sources]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("brand <> ''").distinct().orderBy("brand")


def cars_of_brands(cars: DataFrame, wiki: DataFrame) -> DataFrame:
    """(brand, car) with the sorted set of classes: page cars by their own, register cars by their matches."""
    pages = wiki.select(F.col("brand_name").alias("brand"), F.col("car_name").alias("car"), "category")
    register = matched_categories(cars, wiki, "manufacturer", "model").select(F.col("manufacturer").alias("brand"), F.col("model").alias("car"), "category")
    return pages.unionByName(register).groupBy("brand", "car").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def _listed_cars(cars: DataFrame) -> DataFrame:
    """(brand, folded, name, year, description, hash_id): matched cars of an allowed fuel by cleaned model; model names that
    differ in case are one."""
    useful = cars.filter(F.col("fuel_type").isin(*ALLOWED_FUELS) & (F.size("wiki_hashes") > 0))
    rows = useful.select(F.col("manufacturer").alias("brand"), clean_model(stripped(F.col("model")), F.col("year")).alias("name"), "year", stripped(F.col("description")).alias("description"), "hash_id")
    return rows.withColumn("folded", F.lower("name"))


def car_ids(cars: DataFrame) -> DataFrame:
    """(brand, model, year, description, ids): matched cars of an allowed fuel by cleaned model, at three levels: the model,
    its year, its description; a null year or description means all of them. Ids are collected once, at the finest level,
    and merged upward, so the cars are shuffled once. The listing holds all ids of a model in one row, as its reader asks; car_id_counts
    and car_id_rows have no such row."""
    rows = _listed_cars(cars).groupBy("brand", "folded", "year", "description").agg(F.min("name").alias("model"), F.array_sort(F.collect_list("hash_id")).alias("ids"))
    up = lambda df, *keys: df.groupBy("brand", "folded", *keys).agg(F.min("model").alias("model"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    years = up(rows, "year")
    none = lambda t: F.lit(None).cast(t)
    levels = [
        rows.select("brand", "model", "year", "description", F.lit("description").alias("level"), "ids"),
        years.select("brand", "model", "year", none("string").alias("description"), F.lit("year").alias("level"), "ids"),
        up(years).select("brand", "model", none("int").alias("year"), none("string").alias("description"), F.lit("all").alias("level"), "ids"),
    ]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def car_id_counts(cars: DataFrame) -> DataFrame:
    """(brand, model, year, description, level, n, first_id, last_id): the levels of car_ids with the number of ids and the
    least and greatest, all of which add up on the map side, so that no row holds a hot model's ids."""
    finest = _listed_cars(cars).groupBy("brand", "folded", "year", "description").agg(F.min("name").alias("model"), F.count("*").alias("n"), F.min("hash_id").alias("first_id"), F.max("hash_id").alias("last_id"))
    b, m, y, d = (F.col(c) for c in ("brand", "folded", "year", "description"))
    out = finest.groupingSets([(b, m), (b, m, y), (b, m, y, d)], b, m, y, d).agg(F.min("model").alias("model"), F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.grouping_id().alias("g"))
    return out.select("brand", "model", "year", "description", F.when(F.col("g") == 0, "description").when(F.col("g") == 1, "year").otherwise("all").alias("level"), "n", "first_id", "last_id")


def car_id_rows(cars: DataFrame) -> DataFrame:
    """(brand, model, year, description, hash_id): the listing as plain rows, one for each car."""
    return _listed_cars(cars).select("brand", F.col("folded").alias("model"), "year", "description", "hash_id")


def nested_car_ids(ids: DataFrame) -> DataFrame:
    """car_ids as one row for each brand and model: all ids, and a map of years to ids."""
    years = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("level") == "year", F.struct(F.col("year").cast("string").alias("k"), F.col("ids").alias("v"))))))
    return ids.groupBy("brand", "model").agg(F.first(F.when(F.col("level") == "all", F.col("ids")), ignorenulls=True).alias("all_ids"), years.alias("by_year"))


def grouped(rows: DataFrame, *keys: str, sort: list[str]) -> DataFrame:
    """The rows of each key as a sorted array of structs. For listings whose groups are small (the cars of a brand)."""
    rest = [*sort, *[c for c in rows.columns if c not in (*keys, *sort)]]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))


def match_counts(things: DataFrame) -> DataFrame:
    """Matched and unmatched rows, and distinct sets of matches."""
    some = F.coalesce(F.size("wiki_hashes"), F.lit(0)) > 0
    return things.agg(F.count_if(some).alias("matched"), F.count_if(~some).alias("unmatched"), F.countDistinct(F.when(some, F.array_sort("wiki_hashes"))).alias("unique_matches"))


def per_class(things: DataFrame, wiki: DataFrame, key: str, brand: str, stats: DataFrame | None = None) -> DataFrame:
    """By class: cars, brands, page cars, and cars of each fuel. A car counts once in a class. With stats (key, phenomenon,
    numb_measurements) also the measurements: of each car the count of its most measured phenomenon, once in a class."""
    rows = things.select(key, brand, "fuel_type", F.explode("wiki_hashes").alias("hash_id")).join(wiki.select("hash_id", "category"), "hash_id")
    fuels = [F.countDistinct(F.when(F.col("fuel_type") == f, F.col(key))).alias(f"{f}_cars") for f in ALLOWED_FUELS]
    out = rows.groupBy("category").agg(F.countDistinct(key).alias("cars"), F.countDistinct(folded(F.col(brand))).alias("brands"), F.countDistinct("hash_id").alias("page_cars"), *fuels)
    if stats is None:
        return out
    most = stats.groupBy(key).agg(F.max("numb_measurements").alias("most"))
    sums = rows.select(key, "category").distinct().join(most, key).groupBy("category").agg(F.sum("most").alias("measurements"))
    return out.join(sums, "category", "left").withColumn("measurements", F.coalesce("measurements", F.lit(0)))


def per_brand(things: DataFrame, wiki: DataFrame, key: str, brand: str) -> DataFrame:
    """By brand: cars, the sorted set of classes, and cars of each fuel."""
    classes = matched_categories(things, wiki, brand).groupBy(brand).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    counts = things.groupBy(brand).agg(F.count("*").alias("cars"), *[F.count_if(F.col("fuel_type") == f).alias(f"{f}_cars") for f in ALLOWED_FUELS])
    return counts.join(classes, brand, "left")


def fleet_means(sensors: DataFrame, stats: DataFrame) -> DataFrame:
    """By fuel: litres per 100 km and grams of CO2 per km, weighted means over sensors, where the mean's whole part is above
    zero. One pass: a sensor's phenomena become columns."""
    of = lambda p, c: F.max(F.when(F.col("phenomenon") == p, F.col(c)))
    wide = stats.groupBy("sensor_id").agg(*[of(p, c).alias(f"{p}_{c}") for p in ("Speed", "Consumption", "CO2") for c in ("avg", "numb_measurements")])
    joined = wide.join(sensors.select("sensor_id", "fuel_type"), "sensor_id").filter(F.col("fuel_type").isin(*ALLOWED_FUELS))
    value = lambda p, k: F.when(F.floor(f"{p}_avg") > 0, F.try_divide(F.col(f"{p}_avg"), F.col("Speed_avg")) * k)
    return joined.groupBy("fuel_type").agg(
        weighted_mean(value("Consumption", 100), F.col("Consumption_numb_measurements")).alias("liter_per_100km"), weighted_mean(value("CO2", 1000), F.col("CO2_numb_measurements")).alias("co2_gram_per_km")
    )


def funnel(sensors: DataFrame, stats: DataFrame) -> DataFrame:
    """How many sensors there are, have a brand, have statistics too, and have both speed and consumption too."""
    flags = stats.groupBy("sensor_id").agg(F.lit(True).alias("has"), (F.count_if(F.col("phenomenon") == "Speed") * F.count_if(F.col("phenomenon") == "Consumption") > 0).alias("usable"))
    j = sensors.join(flags, "sensor_id", "left")
    named = F.coalesce(folded(F.col("brand")) != "", F.lit(False))
    has, usable = F.coalesce("has", F.lit(False)), F.coalesce("usable", F.lit(False))
    return j.agg(F.count("*").alias("raw"), F.count_if(named).alias("named"), F.count_if(named & has).alias("with_statistics"), F.count_if(named & usable).alias("usable"))
