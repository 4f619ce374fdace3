"""Scans of landed files: code lists, boundaries, the register, prices, sensor and track pages, page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fuel_type, key_of, stripped, year_in_name
from ..operators.prices import constants, excel_date, filled_blocks
from ..operators.spatial import multi_polygon

# Columns of the code list, and what a register's headers are called here.
COUNTRY_COLUMNS = {
    "official_name_en": "name", "ISO3166-1-Alpha-2": "country_alpha_2", "ISO3166-1-Alpha-3": "country_alpha_3", "ISO3166-1-numeric": "country_numeric",
    "ISO4217-currency_alphabetic_code": "currency_code", "ISO4217-currency_name": "currency_name",
}
REGISTER_COLUMNS = {
    "Manufacturer": "manufacturer", "Model": "model", "Description": "description", "Transmission": "transmission", "Transmission Type": "transmission_type", "Engine Capacity": "engine_capacity", "Fuel Type": "fuel_type",
    "Electric energy consumption Miles/kWh": "e_consumption_miles_per_kWh", "wh/km": "e_consumption_wh_per_km", "Maximum range (Km)": "maximum_range_km", "Maximum range (Miles)": "maximum_range_miles",
    "Metric Urban (Cold)": "metric_urban_cold", "Metric Extra-Urban": "metric_extra_urban", "Metric Combined": "metric_combined",
    "Imperial Urban (Cold)": "imperial_urban_cold", "Imperial Extra-Urban": "imperial_extra_urban", "Imperial Combined": "imperial_combined", "CO2 g/km": "co2_g_per_km",
    "Fuel Cost 6000 Miles": "fuel_cost_6000_miles", "Fuel Cost 12000 Miles": "fuel_cost_12000_miles", "Electricity cost": "electricity_cost", "Total cost / 12000 miles": "total_cost_per_12000_miles",
    "Euro Standard": "euro_standard", "Noise Level dB(A)": "noise_level_dB_a_", "Emissions CO [mg/km]": "emissions_co_mg_per_km", "THC Emissions [mg/km]": "thc_emissions_mg_per_km",
    "Emissions NOx [mg/km]": "emissions_nox_mg_per_km", "THC + NOx Emissions [mg/km]": "thc_plus_nox_emissions_mg_per_km", "Particulates [No.] [mg/km]": "particulates_no_mg_per_km",
    "RDE NOx Urban": "rde_nox_urban", "RDE NOx Combined": "rde_nox_combined", "Date of change": "date_of_change",
}
REGISTER_TEXT = ("manufacturer", "model", "description", "transmission", "transmission_type", "fuel_type", "euro_standard", "date_of_change")
FUEL_COLUMNS = {"euro": "euro_super_95", "diesel": "diesel"}


def country_codes(spark: SparkSession, path: str) -> DataFrame:
    """The code list's columns that are used, by header; rows without a two-letter code go."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    return rows.select(*[(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")).alias(n) for c, n in COUNTRY_COLUMNS.items()]).filter("country_alpha_2 is not null")


_BOUNDARY = "properties struct<iso_a2:string,iso_a3:string>, geometry string"


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(iso_a2, iso_a3, polygons) from lines of GeoJSON; a polygon becomes a multi-polygon of one, points (x, y)."""
    rows = spark.read.schema(_BOUNDARY).json(path)
    kind = F.get_json_object("geometry", "$.type")
    inner = F.get_json_object("geometry", "$.coordinates")
    polygon = F.from_json(inner, "array<array<array<double>>>")
    multi = F.from_json(inner, "array<array<array<array<double>>>>")
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    shaped = F.transform(multi_polygon(kind, F.when(kind == "Polygon", polygon), F.when(kind == "MultiPolygon", multi)), lambda rings: F.transform(rings, points))
    return rows.select("properties.iso_a2", "properties.iso_a3", shaped.alias("polygons"))


def with_boundaries(countries: DataFrame, shapes: DataFrame) -> DataFrame:
    """countries with the polygons of the first shape whose two- or three-letter code is theirs: two equi-joins, as one join
    on either code would compare all pairs."""
    first = lambda code: shapes.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.min_by("polygons", F.to_json("polygons")).alias("p"))
    two, three = first("iso_a2").withColumnRenamed("p", "p2"), first("iso_a3").withColumnRenamed("p", "p3")
    out = countries.join(two, F.col("country_alpha_2") == two["code"], "left").drop("code").join(three, F.col("country_alpha_3") == three["code"], "left").drop("code")
    return out.withColumn("polygons", F.coalesce("p2", "p3")).drop("p2", "p3")


def register(spark: SparkSession, path: str, as_of: int) -> DataFrame:
    """The car register's CSV in Windows' western encoding: named columns, empty and N/A as null, measures as numbers, the
    date of change as a date; year from the description or model, else from that date. Spark reads this encoding only
    with spark.sql.legacy.javaCharsets, which is set here."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.csv(path, header=True, encoding="windows-1252")
    by_header = {stripped_name.strip(): stripped_name for stripped_name in raw.columns}
    pick = lambda h: F.col(f"`{by_header[h]}`") if h in by_header else F.lit(None).cast("string")
    clean = lambda c: F.when(~stripped(c).isin("", "N/A"), stripped(c))
    rows = raw.select(*[clean(pick(h)).alias(n) for h, n in REGISTER_COLUMNS.items()])
    rows = rows.withColumns({n: F.col(n).try_cast("double") for n in REGISTER_COLUMNS.values() if n not in REGISTER_TEXT})
    rows = rows.withColumn("date_of_change", F.try_to_date("date_of_change", "d MMMM yyyy"))
    year = F.coalesce(year_in_name(F.concat_ws(" ", "description", "model"), as_of), F.year("date_of_change"))
    return rows.withColumns({"fuel_type": fuel_type(F.col("fuel_type")), "year": year})


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def price_rows(sheet: DataFrame, countries: DataFrame, datemode: int = 0) -> DataFrame:
    """Price rows of the older history (code, serial, taux, euro_price, euro, diesel as text): dates from serial numbers,
    blanks as zero, only known countries, by two- or three-letter code, and the constants."""
    codes = countries.select("country_alpha_2", F.explode(F.array_distinct(F.array("country_alpha_2", "country_alpha_3"))).alias("code")).filter("code is not null")
    rows = sheet.join(codes, "code").filter(F.col("serial").try_cast("double").isNotNull())
    return rows.select(
        F.col("country_alpha_2").alias("country"), excel_date(F.col("serial").try_cast("double"), datemode).alias("date"), _number("taux").alias("taux"), _number("euro_price").alias("euro_price"),
        *[_number(c).alias(n) for c, n in FUEL_COLUMNS.items()],
    ).withColumns({"unit": F.lit("liter"), "quantity": F.lit(1000)})


def block_prices(sheet: DataFrame) -> DataFrame:
    """Price rows of the newer history, whose sheets hold blocks under a country's code, with the constants."""
    return constants(filled_blocks(sheet)).withColumnRenamed("code", "country")


def general_prices(sheet: DataFrame, datemode: int = 0) -> DataFrame:
    """The sheet for all countries: rows with a serial number for a date."""
    rows = sheet.filter(F.col("serial").try_cast("double").isNotNull())
    return constants(rows.select(excel_date(F.col("serial").try_cast("double"), datemode).alias("date"), *[_number(c).alias(n) for c, n in FUEL_COLUMNS.items()]))


def phenomena(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("phenomenons array<struct<name:string,unit:string>>").json(path, multiLine=True)
    return rows.select(F.inline("phenomenons")).distinct()


def sensors(spark: SparkSession, path: str) -> DataFrame:
    """Sensors of all pages in a folder; feature collections aren't sensors."""
    schema = "sensors array<struct<type:string,properties:struct<id:string,manufacturer:string,model:string,fuelType:string,constructionYear:int>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("sensors").alias("s")).filter("s.type <> 'FeatureCollection'")
    p = "s.properties."
    return rows.select(F.col(p + "id").alias("sensor_id"), F.col("s.type").alias("sensor_type"), F.col(p + "manufacturer").alias("manufacturer_raw"), F.col(p + "model").alias("car_model"), F.col(p + "fuelType").alias("fuel_raw"), F.col(p + "constructionYear").alias("construction_year"))


_STATISTICS = "array<struct<max:double,avg:double,min:double,measurements:long,tracks:long,users:long,sensors:long,phenomenon:struct<name:string,unit:string>>>"


def entity_statistics(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row for each (sensor or track, phenomenon) of statistics pages; key names the id that a page carries."""
    rows = spark.read.schema(f"{key} string, statistics {_STATISTICS}").json(path, multiLine=True).select(key, F.explode("statistics").alias("s"))
    return rows.select(key, F.col("s.phenomenon.name").alias("phenomenon"), "s.max", "s.avg", "s.min", F.col("s.measurements").alias("numb_measurements"), F.col("s.tracks").alias("numb_tracks"), F.col("s.users").alias("numb_users"), F.col("s.sensors").alias("numb_sensors"))


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, sensor_id, track_length) of all pages; no length is zero."""
    schema = "tracks array<struct<id:string,length:double,sensor:struct<properties:struct<id:string>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("tracks").alias("t"))
    return rows.select(F.col("t.id").alias("track_id"), F.col("t.sensor.properties.id").alias("sensor_id"), F.coalesce("t.length", F.lit(0.0)).alias("track_length"))


FEATURES = "properties struct<id:string,sensor:struct<properties:struct<id:string>>>, features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<id:string,time:timestamp,phenomenons:map<string,struct<value:double,unit:string>>>>>"


def track_features(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of a track's measurements (schema FEATURES) as two tables: points, and one row for each measured value."""
    each = pages.select(F.col("properties.id").alias("track_id"), F.col("properties.sensor.properties.id").alias("sensor_id"), F.explode("features").alias("f"))
    base = [F.col("f.properties.id").alias("track_measurement_id"), "track_id", "sensor_id"]
    xy = F.col("f.geometry.coordinates")
    points = each.select(*base, xy[0].alias("x"), xy[1].alias("y"))
    values = each.select(*base, F.col("f.properties.time").alias("date"), F.explode("f.properties.phenomenons").alias("phenomenon", "v"))
    return points, values.select("track_measurement_id", "track_id", "sensor_id", "phenomenon", F.col("v.value").alias("phenomenon_value"), "date")


def of_tracks(rows: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of the wanted tracks only; limit caps the number of tracks in a trial import."""
    ids = wanted.select("track_id").distinct()
    return rows.join(ids if limit is None else ids.orderBy("track_id").limit(limit), "track_id", "left_semi")


def category_members(rows: DataFrame) -> DataFrame:
    """Category listings (category, members) as (category, page_language, title): English where the category says so."""
    language = F.when(F.col("category").contains("Category"), "en").otherwise("de")
    return rows.select("category", language.alias("page_language"), F.explode("members").alias("title")).distinct()


def missing_texts(wiki: DataFrame, stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """(hash_id, page_text) of pages without a stored text: the first extract found anywhere in the fetched JSON (hash_id,
    body). What follows the field's name is read as JSON again, however long it is; a quoted name inside a text is written
    with escapes there, so it can't be taken for the field."""
    rest = F.get(F.split("body", r'"extract"\s*:', 2), F.lit(1))
    text = F.from_json(F.concat(F.lit('{"t":'), rest), "t string")["t"]
    wanted = wiki.select("hash_id").distinct().join(stored.filter("page_text is not null").select("hash_id"), "hash_id", "left_anti")
    return fetched.join(wanted, "hash_id", "left_semi").select("hash_id", text.alias("page_text")).filter("page_text is not null")


def lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dictionary (brands, vehicles, aliases, ignored titles, classes, curated matches) from lines of JSON."""
    return spark.read.schema(schema).json(path)


def stored(spark: SparkSession, path: str, **equal) -> DataFrame:
    """A stored table, filtered by equality where asked; the filters reach the scan."""
    out = spark.read.parquet(path)
    for c, x in equal.items():
        out = out.filter(F.col(c) == x)
    return out


#: What an import of sensor data produces, by profile.
PROFILES = {"sensors": ("sensors",), "averages": ("sensors", "sensor_statistics"), "tracks": ("sensors", "sensor_statistics", "tracks", "track_statistics"), "all": ("sensors", "sensor_statistics", "tracks", "track_statistics", "track_measurements", "track_points")}


def profile(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """The tables of a profile; those it doesn't name are never computed, as nothing has run yet."""
    return {t: tables[t] for t in PROFILES[name] if t in tables}


def newest_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def with_key(df: DataFrame, column: str, *parts: str) -> DataFrame:
    return df.withColumn(column, key_of(*[F.col(p) for p in parts]))
