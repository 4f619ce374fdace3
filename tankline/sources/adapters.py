"""The domain's tables as projections of the given star-schema tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORY_CODES = ("a", "b", "c", "d", "e", "f", "s", "m", "j", "pu", "lcv")
PHENOMENON = {"view": "Speed", "click": "Consumption", "purchase": "CO2", "signup": "Rpm", "error": "Engine Load"}
UNITS = {"Speed": "km/h", "Consumption": "l/h", "CO2": "kg/h", "Rpm": "u/min", "Engine Load": "%"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wiki_hash(n: Column) -> Column:
    return F.md5(F.concat(F.lit("w"), n.cast("string")))


def _parts(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").count()


def _from_map(c: Column, pairs: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), c)


def phenomena(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(UNITS.items()), "name string, unit string")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = _parts(spark, sf_dir), F.col("c_custkey")
    fuels = F.array(*[F.lit(x) for x in ("Petrol", "diesel", "gas", "Diesel ", "Electricity")])
    return table(spark, sf_dir, "customer").select(
        k.alias("sensor_id"), F.lit("car").alias("sensor_type"),
        F.concat("c_mktsegment", F.when(k % 3 == 0, " ").otherwise("")).alias("manufacturer_raw"),
        F.concat(F.lit("model "), (k % 50).cast("string")).alias("car_model"), fuels[(k % 5).cast("int")].alias("fuel_raw"),
        (2000 + k % 20).cast("int").alias("construction_year"), F.array(_wiki_hash(k % n), _wiki_hash((k + 7) % n)).alias("wiki_hashes"),
    )


def sensor_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sensor_id"), "event_type")
    return events.agg(
        F.max("value").alias("max"), F.avg("value").alias("avg"), (F.min("value") - 2).alias("min"), F.count("*").alias("n")
    ).select("sensor_id", _from_map(F.col("event_type"), PHENOMENON).alias("phenomenon"), "max", "avg", "min", (F.col("n") * (1 + F.col("sensor_id") % 30)).alias("numb_measurements"))


def wiki_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in CATEGORY_CODES])
    return table(spark, sf_dir, "part").select(
        _wiki_hash(F.col("p_partkey")).alias("hash_id"), F.col("p_brand").alias("brand_name"), F.col("p_name").alias("car_name"),
        F.concat_ws(" ", "p_brand", "p_name").alias("wiki_name"), codes[(F.col("p_partkey") % 11).cast("int")].alias("category"),
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, brand, tag, page_text): whole documents as texts of page cars, with the name of a car of the brand before commas
    and, at line ends, the page's own car or brand."""
    part = table(spark, sf_dir, "part")
    last = part.groupBy("p_brand").agg(F.max("p_name").alias("last_name"))
    own = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_name")).otherwise(F.col("p_brand"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.pmod("doc_id", F.lit(_parts(spark, sf_dir))).alias("p_partkey"))
    named = F.replace(F.col("text"), F.lit(", "), F.concat(F.lit(" "), F.upper("last_name"), F.lit(", ")))
    woven = F.replace(named, F.lit(".\n"), F.concat(F.lit(" "), own, F.lit(".\n")))
    return docs.join(part.join(last, "p_brand"), "p_partkey").select("doc_id", "lang", F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_brand", "p_name").alias("tag"), woven.alias("page_text"))


def car_hash() -> Column:
    return F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]))


def register_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _parts(spark, sf_dir)
    cars = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return cars.select(
        car_hash().alias("hash_id"),
        F.col("p_brand").alias("manufacturer"), F.col("p_name").alias("model"), F.col("p_type").alias("description"),
        _from_map(F.col("l_returnflag"), {"A": "gasoline", "N": "diesel", "R": "electric"}).alias("fuel_type"), F.year("l_shipdate").alias("year"),
        (F.col("l_quantity") / 5).alias("metric_combined"), (F.col("l_extendedprice") / F.col("l_quantity") / 10).alias("co2_g_per_km"),
        (F.col("l_discount") * 1000).alias("emissions_co_mg_per_km"), (F.col("l_tax") * 1000).alias("emissions_nox_mg_per_km"),
        ((F.col("l_discount") + F.col("l_tax")) * 100).alias("thc_emissions_mg_per_km"),
        (F.col("l_quantity") / 4).alias("metric_urban_cold"), (F.col("l_quantity") / 6).alias("metric_extra_urban"), (60 + F.col("l_linenumber")).cast("double").alias("noise_level_dB_a_"),
        ((F.col("l_discount") + 2 * F.col("l_tax")) * 1000).alias("thc_plus_nox_emissions_mg_per_km"), (F.col("l_linenumber") / 10).alias("particulates_no_mg_per_km"),
        (F.col("l_tax") * 500).alias("rde_nox_urban"), (F.col("l_discount") * 300).alias("rde_nox_combined"),
        *[F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * k).cast("double").alias(n) for n, k in (("e_consumption_miles_per_kWh", 2), ("e_consumption_wh_per_km", 3), ("maximum_range_km", 8), ("maximum_range_miles", 5))],
        F.array(_wiki_hash(F.col("l_partkey")), _wiki_hash((F.col("l_partkey") + 11) % n)).alias("wiki_hashes"),
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of side ten, as (country, polygons): polygons > rings > points, x and y in degrees."""
    x, y = (F.col("n_nationkey") % 5 * 10).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 10).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(point(x, y), point(x + 10, y), point(x + 10, y + 10), point(x, y + 10), point(x, y))
    nations = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 7 != 3)
    return nations.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("country"), F.col("n_name").alias("name"), F.array(F.array(ring)).alias("polygons"))


def country_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    monthly = orders.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country"), F.trunc("o_orderdate", "month").alias("date")).agg(F.avg("o_totalprice").alias("p"))
    return monthly.select("country", "date", *[F.round(F.col("p") / d, 3).alias(c) for c, d in (("euro_ttc", 150), ("euro_ht", 200), ("diesel_ttc", 160), ("diesel_ht", 220))], F.lit(1000).alias("quantity"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("track_id"), F.when(k % 13 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("sensor_id"),
        F.when(k % 17 != 0, F.col("o_totalprice") / 1000).alias("track_length"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("track_measurement_id"), (F.col("event_id") % 997).alias("track_id"), F.col("user_id").alias("sensor_id"),
        _from_map(F.col("event_type"), PHENOMENON).alias("phenomenon"), F.col("value").alias("phenomenon_value"), F.col("ts").alias("date"),
    )


def routes(spark: SparkSession, sf_dir: str, per_supplier: int = 10) -> DataFrame:
    """Requests (see plans.requests) of lines of six points. The file is small and one task would read it, so its rows are dealt first."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = table(spark, sf_dir, "supplier").repartition(tasks, "s_suppkey").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_supplier - 1))))
    s, k = F.col("s_suppkey"), F.col("k")
    x, y = (s * 37 + k * 11) % 40 + 0.25, (s * 17 + k * 7) % 40 + 0.35
    coordinates = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((x + 1.5 * i).alias("x"), (y + 0.9 * i).alias("y")))
    rid = s * 10 + k
    return base.select(
        rid.alias("request_id"), coordinates.alias("coordinates"), F.when(k % 2 == 0, "gasoline").otherwise("diesel").alias("fuel_type"),
        F.when(k % 3 == 0, "fast").otherwise("moderate").alias("driving_style"),
    )


#: The same tables for DuckDB; each reads the given views only.
SQL = {
    "np": "np AS (SELECT count(*) AS n FROM part)",
    "phenomena": "phenomena(name, unit) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in UNITS.items()) + ")",
    "sensors": """sensors AS (SELECT c_custkey AS sensor_id, 'car' AS sensor_type, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END AS manufacturer_raw,
        'model ' || (c_custkey % 50) AS car_model, ['Petrol', 'diesel', 'gas', 'Diesel ', 'Electricity'][c_custkey % 5 + 1] AS fuel_raw,
        ['gasoline', 'diesel', 'gasoline', 'diesel', 'electric'][c_custkey % 5 + 1] AS fuel_type, 2000 + c_custkey % 20 AS construction_year,
        [md5('w' || (c_custkey % n)), md5('w' || ((c_custkey + 7) % n))] AS wiki_hashes FROM customer, np)""",
    "stats": """stats AS (SELECT user_id AS sensor_id, CASE event_type WHEN 'view' THEN 'Speed' WHEN 'click' THEN 'Consumption' WHEN 'purchase' THEN 'CO2' WHEN 'signup' THEN 'Rpm' WHEN 'error' THEN 'Engine Load' END AS phenomenon,
        max(value) AS mx, avg(value) AS av, min(value) - 2 AS mn, count(*) * (1 + user_id % 30) AS w FROM events GROUP BY user_id, event_type)""",
    "wiki": """wiki AS (SELECT md5('w' || p_partkey) AS hash_id, p_brand AS brand_name, p_name AS car_name, p_brand || ' ' || p_name AS wiki_name,
        ['a','b','c','d','e','f','s','m','j','pu','lcv'][p_partkey % 11 + 1] AS category FROM part)""",
    "page_texts": """page_texts AS (SELECT doc_id, lang, p_brand AS brand, p_brand || ' ' || p_name AS tag,
        replace(replace(text, ', ', ' ' || upper(last_name) || ', '), '.' || chr(10), ' ' || CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE p_brand END || '.' || chr(10)) AS page_text
        FROM documents JOIN (SELECT *, max(p_name) OVER (PARTITION BY p_brand) AS last_name FROM part) ON doc_id % (SELECT count(*) FROM part) = p_partkey)""",
    "cars": """cars AS (SELECT md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS hash_id, p_brand AS manufacturer, p_name AS model, p_type AS description,
        CASE l_returnflag WHEN 'A' THEN 'gasoline' WHEN 'N' THEN 'diesel' WHEN 'R' THEN 'electric' END AS fuel_type, year(l_shipdate) AS year,
        l_quantity / 5 AS metric_combined, l_extendedprice / l_quantity / 10 AS co2_g_per_km, l_discount * 1000 AS emissions_co_mg_per_km,
        l_tax * 1000 AS emissions_nox_mg_per_km, (l_discount + l_tax) * 100 AS thc_emissions_mg_per_km,
        l_quantity / 4 AS metric_urban_cold, l_quantity / 6 AS metric_extra_urban, (60 + l_linenumber)::DOUBLE AS noise_level_dB_a_, (l_discount + 2 * l_tax) * 1000 AS thc_plus_nox_emissions_mg_per_km,
        l_linenumber / 10 AS particulates_no_mg_per_km, l_tax * 500 AS rde_nox_urban, l_discount * 300 AS rde_nox_combined, CASE l_returnflag WHEN 'R' THEN l_quantity * 2 END AS e_consumption_miles_per_kWh,
        CASE l_returnflag WHEN 'R' THEN l_quantity * 3 END AS e_consumption_wh_per_km, CASE l_returnflag WHEN 'R' THEN l_quantity * 8 END AS maximum_range_km, CASE l_returnflag WHEN 'R' THEN l_quantity * 5 END AS maximum_range_miles,
        [md5('w' || l_partkey), md5('w' || ((l_partkey + 11) % n))] AS wiki_hashes FROM lineitem JOIN part ON l_partkey = p_partkey, np)""",
    "countries": """countries AS (SELECT 'N' || n_nationkey AS country, n_name AS name, (n_nationkey % 5 * 10)::DOUBLE AS x0, (n_nationkey // 5 * 10)::DOUBLE AS y0 FROM nation WHERE n_nationkey % 7 <> 3)""",
    "prices": """prices AS (SELECT 'N' || c_nationkey AS country, date_trunc('month', o_orderdate)::DATE AS date, round(avg(o_totalprice) / 150, 3) AS euro_ttc,
        round(avg(o_totalprice) / 200, 3) AS euro_ht, round(avg(o_totalprice) / 160, 3) AS diesel_ttc, round(avg(o_totalprice) / 220, 3) AS diesel_ht, 1000 AS quantity
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
    "tracks": """tracks AS (SELECT o_orderkey AS track_id, CASE WHEN o_orderkey % 13 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS sensor_id,
        CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 1000 END AS track_length FROM orders)""",
    "points": """points AS (SELECT s_suppkey * 10 + k AS request_id, k, i, (s_suppkey * 37 + k * 11) % 40 + 0.25::DOUBLE + 1.5::DOUBLE * i AS x, (s_suppkey * 17 + k * 7) % 40 + 0.35::DOUBLE + 0.9::DOUBLE * i AS y
        FROM supplier, range(10) AS ks(k), range(6) AS iss(i))""",
}


def with_sql(names: str, select: str, more: str = "", recursive: bool = False) -> str:
    """select behind the named tables, those that they need, and further common table expressions."""
    asked = set(names.split())
    need = [SQL[n] for n in SQL if n in asked or (n == "np" and asked & {"sensors", "cars"})]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*need, *([more] if more else [])]) + "\n" + select
