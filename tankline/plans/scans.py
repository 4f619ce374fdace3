"""Queries of the readers: what the domain tables hold is written as the pages and files of a source, and scanned again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brands as B
from ..operators import matching
from ..sources import adapters as A
from ..sources import readers, sinks
from .queries import rounded

#: Entries of a written page.
PAGE = 1000
#: A maker that no list of brands has.
UNLISTED = "MACHINERY"
_CURATED = "brand string, entry string, wiki_name string"


def _pages(rows: DataFrame, number: Column, name: str, **fields: Column) -> str:
    """The folder of files of one page each: an object whose field has the entries of a page. A page has PAGE entries at most, as
    numbers are different."""
    path = sinks.scratch(rows.sparkSession, name)
    page = rows.select(F.floor(number / PAGE).alias("page"), *[c.alias(n) for n, c in fields.items()]).groupBy("page").agg(*[F.collect_list(n).alias(n) for n in fields])
    page.select("page", F.to_json(F.struct(*fields)).alias("value")).write.partitionBy("page").text(path)
    return path


def phenomenon_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The phenomena that measurements have, with units, from pages that name them again and again."""
    seen = A.measurements(spark, sf).select(F.floor(F.col("track_id") / 100).alias("page"), "phenomenon").distinct().join(A.phenomena(spark, sf), F.col("phenomenon") == F.col("name"))
    path = sinks.scratch(spark, "phenomenon-pages")
    page = seen.groupBy("page").agg(F.collect_list(F.struct("name", "unit")).alias("phenomenons"))
    page.select("page", F.to_json(F.struct("phenomenons")).alias("value")).write.partitionBy("page").text(path)
    return readers.phenomena(spark, path)


def sensor_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors of pages, without feature collections and those whose maker isn't known."""
    k = F.col("sensor_id")
    kind = F.when(k % 7 == 0, "FeatureCollection").otherwise("Feature").alias("type")
    own = F.struct(k.cast("string").alias("id"), F.lower("manufacturer_raw").alias("manufacturer"), F.col("car_model").alias("model"), F.col("fuel_raw").alias("fuelType"), F.col("construction_year").alias("constructionYear"))
    rows = A.sensors(spark, sf)
    scanned = readers.sensors(spark, _pages(rows, k, "sensor-pages", sensors=F.struct(kind, own.alias("properties"))))
    listed = rows.select(F.trim("manufacturer_raw").alias("brand")).distinct().filter(F.col("brand") != UNLISTED)
    aliases = listed.select("brand", F.col("brand").alias("alias"), F.lit(0).alias("priority"))
    return B.normalized(scanned, "manufacturer_raw", aliases, listed).filter("brand <> ''").select("sensor_id", "sensor_type", "brand", "car_model", "fuel_raw", "construction_year")


def _track_scan(spark: SparkSession, sf: str) -> DataFrame:
    sensor = F.struct(F.struct(F.col("sensor_id").cast("string").alias("id")).alias("properties"))
    entry = F.struct(F.col("track_id").cast("string").alias("id"), F.col("track_length").alias("length"), sensor.alias("sensor"))
    return readers.tracks(spark, _pages(A.tracks(spark, sf), F.col("track_id"), "track-pages", tracks=entry))


def track_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _track_scan(spark, sf)


def wanted_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of pages, those of a list of tracks only: the customers' latest orders."""
    latest = A.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").cast("string").alias("track_id"))
    return readers.of_tracks(_track_scan(spark, sf), latest)


def _statistics_scan(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """Statistics of pages, each a list of an entity's statistics; files hold many pages as one list."""
    m = A.measurements(spark, sf).join(A.phenomena(spark, sf), F.col("phenomenon") == F.col("name"))
    value = F.col("phenomenon_value")
    each = m.groupBy(key, "name", "unit").agg(F.max(value).alias("max"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.count("*").alias("measurements"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("sensor_id").alias("sensors"))
    entry = F.struct("max", "avg", "min", "measurements", "tracks", F.lit(1).alias("users"), "sensors", F.struct("name", "unit").alias("phenomenon"))
    page = each.groupBy(key).agg(F.collect_list(entry).alias("statistics")).select(F.floor(F.col(key) / PAGE).alias("page"), F.struct(F.col(key).cast("string").alias(key), "statistics").alias("entity"))
    path = sinks.scratch(spark, "statistics-pages")
    page.groupBy("page").agg(F.to_json(F.collect_list("entity")).alias("value")).write.partitionBy("page").text(path)
    return rounded(readers.entity_statistics(spark, path, key), 7)


def sensor_statistics_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _statistics_scan(spark, sf, "sensor_id")


def track_statistics_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _statistics_scan(spark, sf, "track_id")


def country_code_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A code list with a column that isn't read, one that is missing, quoted commas and quotes, and rows without a code."""
    path = sinks.scratch(spark, "country-codes")
    n = F.col("n_nationkey")
    code = F.when(n % 6 != 5, F.upper(F.substring("n_name", 1, 2)))
    rows = A.table(spark, sf, "nation").select(
        F.lit("x").alias("FIFA"), F.concat("n_name", F.lit(', the "'), n.cast("string"), F.lit('"')).alias("official_name_en"), code.alias("ISO3166-1-Alpha-2"),
        F.upper(F.substring("n_name", 1, 3)).alias("ISO3166-1-Alpha-3"), n.cast("string").alias("ISO3166-1-numeric"), F.when(n % 2 == 0, "EUR").alias("ISO4217-currency_alphabetic_code"),
    )
    rows.write.csv(path, header=True, escape='"')
    return readers.country_codes(spark, path)


def curated_list(spark: SparkSession, sf: str) -> DataFrame:
    """A curated list of names, with and without their year, written as lines and looked up for the register's cars."""
    path = sinks.scratch(spark, "curated")
    cars = A.register_cars(spark, sf)
    name = F.concat_ws(" ", "model", "description")
    entry = F.when(F.col("year") % 2 == 0, F.concat(name, F.col("year").cast("string"))).otherwise(F.upper(name))
    entries = cars.filter("year % 3 <> 0").select(F.col("manufacturer").alias("brand"), entry.alias("entry"), F.concat_ws(" ", "manufacturer", "model").alias("wiki_name")).distinct()
    sinks.write_json_documents(entries, path)
    asked = cars.select(F.col("hash_id").alias("car_id"), F.col("manufacturer").alias("brand"), name.alias("name"), "year")
    found = matching.curated_names(asked, readers.lookup(spark, path, _CURATED), A.wiki_cars(spark, sf))
    return found.per_car(F.count("*").alias("pages"), F.min("hash_id").alias("first_page")).drop("stage")


def import_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The tables that each profile of an import brings, with their rows."""
    made = {"sensors": A.sensors(spark, sf), "sensor_statistics": A.sensor_statistics(spark, sf), "tracks": A.tracks(spark, sf), "track_measurements": A.measurements(spark, sf)}
    parts = [t.agg(F.lit(p).alias("profile"), F.lit(n).alias("brings"), F.count("*").alias("rows")) for p in readers.PROFILES for n, t in readers.profile(made, p).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_PHENOMENON = "CASE event_type WHEN 'view' THEN 'Speed' WHEN 'click' THEN 'Consumption' WHEN 'purchase' THEN 'CO2' WHEN 'signup' THEN 'Rpm' WHEN 'error' THEN 'Engine Load' END"
_TRACK = "o_orderkey::VARCHAR AS track_id, (CASE WHEN o_orderkey % 13 = 0 THEN -o_custkey - 1 ELSE o_custkey END)::VARCHAR AS sensor_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 1000 ELSE 0 END AS track_length"


def _statistics(key: str, column: str) -> str:
    return f"SELECT ({key})::VARCHAR AS {column}, {_PHENOMENON} AS phenomenon, round(max(value), 7) AS max, round(avg(value), 7) AS avg, round(min(value), 7) AS min, count(*) AS numb_measurements, count(DISTINCT event_id % 997) AS numb_tracks, 1 AS numb_users, count(DISTINCT user_id) AS numb_sensors FROM events GROUP BY 1, 2"


ORACLE_SQL = {
    "phenomenon_pages": A.with_sql("phenomena", f"SELECT name, unit FROM phenomena WHERE name IN (SELECT {_PHENOMENON} FROM events)"),
    "sensor_pages": A.with_sql("sensors", f"SELECT sensor_id::VARCHAR AS sensor_id, 'Feature' AS sensor_type, trim(manufacturer_raw) AS brand, car_model, fuel_raw, construction_year FROM sensors WHERE sensor_id % 7 <> 0 AND trim(manufacturer_raw) <> '{UNLISTED}'"),
    "track_pages": f"SELECT {_TRACK} FROM orders",
    "wanted_tracks": f"SELECT {_TRACK} FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)",
    "sensor_statistics_pages": _statistics("user_id", "sensor_id"),
    "track_statistics_pages": _statistics("event_id % 997", "track_id"),
    "country_code_scan": """SELECT n_name || ', the "' || n_nationkey || '"' AS name, upper(n_name[:2]) AS country_alpha_2, upper(n_name[:3]) AS country_alpha_3, n_nationkey::VARCHAR AS country_numeric,
        CASE WHEN n_nationkey % 2 = 0 THEN 'EUR' END AS currency_code, NULL::VARCHAR AS currency_name FROM nation WHERE n_nationkey % 6 <> 5""",
    "curated_list": A.with_sql(
        "cars wiki",
        """SELECT car_id, count(*) AS pages, min(hash_id) AS first_page FROM (SELECT DISTINCT r.car_id, w.hash_id FROM asked r JOIN entries e ON e.brand = r.brand AND e.entry IN (r.name, r.name || r.year)
        JOIN wiki w USING (wiki_name)) GROUP BY car_id""",
        """asked AS (SELECT hash_id AS car_id, manufacturer AS brand, lower(model || ' ' || description) AS name, year FROM cars),
        entries AS (SELECT DISTINCT manufacturer AS brand, lower(model || ' ' || description) || CASE WHEN year % 2 = 0 THEN year::VARCHAR ELSE '' END AS entry, manufacturer || ' ' || model AS wiki_name FROM cars WHERE year % 3 <> 0)""",
    ),
    "import_profiles": A.with_sql(
        "sensors stats tracks",
        """SELECT p AS profile, t AS brings, n AS rows FROM (VALUES ('sensors', 1), ('averages', 2), ('tracks', 3), ('all', 4)) v(p, k)
        JOIN (SELECT 1 AS least, 'sensors' AS t, count(*) AS n FROM sensors UNION ALL SELECT 2, 'sensor_statistics', count(*) FROM stats UNION ALL SELECT 3, 'tracks', count(*) FROM tracks UNION ALL SELECT 4, 'track_measurements', count(*) FROM events) ON least <= k""",
    ),
}
