"""The registered queries: the operators over the domain tables that sources.adapters derives from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths, text
from ..operators import brands as B
from ..operators import listings, matching, names, network, prices, routes, sensors, similarity, spatial, statistics, tagger
from ..sources import adapters as A
from ..sources import readers, sinks, tables

PLACES = 4
SWEEP = (50, 130, 40)


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles rounded, so that the order of a sum can't show, and dates as text."""
    change = {"double": lambda c: F.round(c, places), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[change.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


# statistics


def avg_vehicle_type(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.vehicle_type_averages(A.sensors(spark, sf), A.sensor_statistics(spark, sf)))


def avg_manufacturer(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.manufacturer_averages(A.sensors(spark, sf), A.sensor_statistics(spark, sf)))


def _category_stats(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.category_averages(A.sensors(spark, sf), A.sensor_statistics(spark, sf), A.wiki_cars(spark, sf))


def _register_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The means that costs need."""
    return statistics.register_averages(A.register_cars(spark, sf), A.wiki_cars(spark, sf), statistics.REGISTER_MEASURES)


def _sensor_models(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.sensor_fuel_models(_category_stats(spark, sf))


def avg_category_sensor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_category_stats(spark, sf))


def avg_category_register(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.register_averages(A.register_cars(spark, sf), A.wiki_cars(spark, sf)))


def category_units(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.with_units(_category_stats(spark, sf), A.phenomena(spark, sf)))


def register_measures_long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.unpivot_measures(A.register_cars(spark, sf), "hash_id", "fuel_type").groupBy("phenomenon", "fuel_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


def measurement_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.statistics_from_measurements(A.measurements(spark, sf), "sensor_id"), 6)


def sensor_fuel_model(spark: SparkSession, sf: str) -> DataFrame:
    v = F.lit(70.0)
    of = lambda what: maths.parabola(v, F.lit(0.0), F.col(f"{what}_min"), F.col("speed_average"), F.col(f"{what}_average"), F.col("speed_max"), F.col(f"{what}_max"))
    return rounded(_sensor_models(spark, sf).select("category", "fuel_type", of("cons").alias("liters_per_hour"), of("co2").alias("co2_kg_per_hour"), (of("cons") / v).alias("liters_per_km")))


def register_fuel_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.register_models(_register_stats(spark, sf), 1995))


def growth_factor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(routes.growth_factors(_sensor_models(spark, sf), F.lit(90.0)).select("category", "fuel_type", "g_fuel", "g_co2"))


# prices


def latest_country_price(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prices.latest(A.country_prices(spark, sf), "country"), 6)


def first_price_year(spark: SparkSession, sf: str) -> DataFrame:
    return prices.first_year(A.country_prices(spark, sf))


def eu_mean_price(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prices.mean_over_countries(A.country_prices(spark, sf)))


def latest_general_price(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(prices.latest(prices.mean_over_countries(A.country_prices(spark, sf))), 6)


def merged_price_history(spark: SparkSession, sf: str) -> DataFrame:
    """An older history up to 1999 and a newer one from 1997 on, without a value for every fourth month."""
    p = A.country_prices(spark, sf)
    new = p.filter(F.year("date") >= 1997).withColumn("euro_ttc", F.when(F.month("date") % 4 != 0, F.col("euro_ttc") * 2))
    return rounded(prices.merged_histories(p.filter(F.year("date") <= 1999), new, "country", "date"))


def merged_tax_sides(spark: SparkSession, sf: str) -> DataFrame:
    p = A.country_prices(spark, sf)
    side = lambda k, end: p.filter(F.month("date") % k != 0).select("country", "date", F.col(f"euro_{end}").alias("euro_super_95"), F.col(f"diesel_{end}").alias("diesel"))
    return rounded(prices.merged_tax_sides(side(5, "ttc"), side(7, "ht"), "country", "date"))


def price_block_fill(spark: SparkSession, sf: str) -> DataFrame:
    p = A.country_prices(spark, sf).select("country", "date", "euro_ttc")
    heads = p.select("country").distinct().select("country", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("euro_ttc"), F.col("country").alias("code"))
    rows = p.withColumn("code", F.lit(None).cast("string")).unionByName(heads)
    number = F.substring("country", 2, 9).cast("int")
    sheet = rows.select((number % 3).alias("sheet"), (number * 1000 + F.coalesce(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(-1)) / 100000).alias("row_idx"), "code", "date", "euro_ttc")
    return rounded(prices.filled_blocks(sheet).select("sheet", "code", "date", "euro_ttc"))


def foreign_prices(spark: SparkSession, sf: str) -> DataFrame:
    p = A.country_prices(spark, sf).withColumns({"taux": F.year("date") - 1990.0, "euro_price": F.when(F.month("date") % 2 == 0, 0.0).otherwise(1.0)})
    return rounded(prices.in_euros(p, "euro_ttc", "diesel_ttc").select("country", "date", "euro_ttc", "diesel_ttc"))


def incremental_prices(spark: SparkSession, sf: str) -> DataFrame:
    p = A.country_prices(spark, sf)
    return rounded(prices.not_yet_stored(p, p.filter(F.year("date") < 1998), "country", "date").select("country", "date", "euro_ttc", "diesel_ttc"))


def upsert_prices(spark: SparkSession, sf: str) -> DataFrame:
    p = A.country_prices(spark, sf).select("country", "date", "euro_ttc")
    new = p.filter(F.month("date") == 1).withColumn("euro_ttc", F.col("euro_ttc") * 2)
    return rounded(sinks.upserted(p, new, "country", "date"))


# sensors and tracks


def sensor_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sensors.match_counts(sensors.with_statistics(A.sensors(spark, sf), A.sensor_statistics(spark, sf)))


def sensor_track_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sensors.track_rollup(A.sensors(spark, sf).select("sensor_id", "car_model"), A.tracks(spark, sf)), 2)


def track_repair(spark: SparkSession, sf: str) -> DataFrame:
    known = A.sensors(spark, sf).select("sensor_id")
    aliases = known.filter("sensor_id % 2 = 0").select((-F.col("sensor_id") - 1).alias("sensor_id"), F.col("sensor_id").alias("real_id"))
    return rounded(sensors.repaired_tracks(A.tracks(spark, sf), known, aliases), 5)


def fuel_labels(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.with_fuel(A.sensors(spark, sf)).groupBy("fuel_raw", "fuel_type").agg(F.count("*").alias("n"))


# routes


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return A.routes(spark, sf)


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    p = A.country_prices(spark, sf)
    return routes.parts_of_requests(routes.priced_parts(_requests(spark, sf), A.countries(spark, sf), p, prices.mean_over_countries(p)))


def route_length(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.route_lengths(_requests(spark, sf)), 3)


def route_parts(spark: SparkSession, sf: str) -> DataFrame:
    pieces = spatial.overlay(_requests(spark, sf), A.countries(spark, sf))
    return rounded(spatial.metric_lengths(pieces, "request_id", "country").withColumn("country", F.coalesce("country", F.lit("-"))), 3)


def point_country(spark: SparkSession, sf: str) -> DataFrame:
    points = _requests(spark, sf).select("request_id", F.posexplode("coordinates").alias("i", "c")).select((F.col("request_id") * 10 + F.col("i")).alias("point_id"), "c.x", "c.y")
    found = spatial.point_countries(points, A.countries(spark, sf)).join(prices.latest(A.country_prices(spark, sf), "country"), "country", "left")
    return rounded(found.select("point_id", "country", "date", "euro_ttc"), 6)


def point_distances(spark: SparkSession, sf: str) -> DataFrame:
    points = _requests(spark, sf).select(F.col("request_id").alias("route"), F.posexplode("coordinates").alias("seq", "c")).select("route", "seq", "c.x", "c.y")
    return rounded(spatial.point_distances(points).select("route", "seq", "meters"), 2)


def route_cost_register(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of all requests in all classes by the register's means: the flagship."""
    return routes.register_costs(_requests(spark, sf), _parts(spark, sf), _register_stats(spark, sf), _sensor_models(spark, sf))


def route_cost_sensor(spark: SparkSession, sf: str) -> DataFrame:
    return routes.sensor_costs(_requests(spark, sf), _parts(spark, sf), _sensor_models(spark, sf))


def route_cost_cars(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of the cars that a request names: those of orders with its number."""
    lines = A.table(spark, sf, "lineitem")
    ids = lines.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.array_sort(F.collect_set(A.car_hash())).alias("cfd_ids"))
    return routes.car_costs(_requests(spark, sf).join(spatial.unsized(ids), "request_id"), _parts(spark, sf), A.register_cars(spark, sf), _sensor_models(spark, sf), A.wiki_cars(spark, sf))


def speed_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return routes.speed_sweep(_requests(spark, sf), _parts(spark, sf), _register_stats(spark, sf), _sensor_models(spark, sf), *SWEEP)


def route_cost_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for some classes at a speed of their own, with a tank and a consumption given."""
    tanks, litres = F.create_map(F.lit("b"), F.lit(30)), F.create_map(F.lit("c"), F.lit(7.5))
    asked = _requests(spark, sf).withColumns({"vehicle_categories": F.array(F.lit("b"), F.lit("c")), "tank_sizes": tanks, "fuel_consumptions": litres, "driving_speed": F.lit(100)})
    return routes.sensor_costs(asked, _parts(spark, sf), _sensor_models(spark, sf)).select("request_id", "category", "manual_consumption", "liters", "w_tax_euro", "wo_tax_euro", "liter_per_100km")


def route_answer_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of route_answers read again: one row for each request and class."""
    costs = route_cost_sensor(spark, sf)
    fields = ", ".join(f"{c}:{t}" for c, t in costs.dtypes if c not in ("request_id", "category"))
    read = routes.answers(costs).select("request_id", F.from_json("body", f"fuel_stats map<string,struct<{fields}>>").alias("d"))
    rows = read.select("request_id", F.explode("d.fuel_stats").alias("category", "s"))
    return rows.select("request_id", "category", "s.fuel_type", "s.km", "s.liters", "s.w_tax_euro", "s.wo_tax_euro", "s.price_date", "s.liter_per_100km", "s.calculation_errors")


def route_answers(spark: SparkSession, sf: str) -> DataFrame:
    return routes.answers(route_cost_sensor(spark, sf))


def request_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as JSON bodies, some of them wrong, with their error codes."""
    k = F.col("request_id")
    line = F.transform("coordinates", lambda c: F.array(c["x"], c["y"]))
    shape = F.struct(F.when(k % 7 == 1, "Polygon").otherwise("LineString").alias("type"), line.alias("coordinates"))
    filters = F.struct(F.when(k % 5 != 2, F.when(k % 5 == 3, "none").otherwise("cfd")).alias("data_source"), F.when(k % 11 != 4, F.col("fuel_type")).alias("fuel_type"))
    geometry = F.struct(F.when(k % 13 != 5, shape).alias("geojson"), F.when(k % 17 != 6, filters).alias("filters"))
    body = F.to_json(F.struct(F.when(k % 19 == 7, "list").otherwise("route").alias("request"), F.when(k % 23 != 8, geometry).alias("geometry")))
    bodies = _requests(spark, sf).select("request_id", F.when(k % 29 == 9, "{").otherwise(body).alias("body"))
    return routes.parsed(bodies).select("request_id", "error_code", F.size("coordinates").alias("points"))


# listings and reports


def _sensor_names(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.with_fuel(A.sensors(spark, sf)).withColumn("brand", text.stripped(F.col("manufacturer_raw")))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    sources = (A.wiki_cars(spark, sf).select(F.col("brand_name").alias("brand")), A.register_cars(spark, sf).select(F.col("manufacturer").alias("brand")), _sensor_names(spark, sf))
    return listings.brands(*sources)


def cars(spark: SparkSession, sf: str) -> DataFrame:
    out = listings.cars_of_brands(A.register_cars(spark, sf), A.wiki_cars(spark, sf))
    return out.withColumn("categories", F.array_join("categories", ","))


def car_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = listings.car_ids(A.register_cars(spark, sf))
    return ids.select("brand", "model", "year", "description", "level", F.size("ids").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """The classes with the number of page cars in each."""
    counts = A.wiki_cars(spark, sf).groupBy("category").agg(F.count("*").alias("page_cars"))
    return routes.categories(spark).join(counts, "category", "left").select("category", "category_en", "category_de", "tank", F.coalesce("page_cars", F.lit(0)).alias("page_cars"))


def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return listings.match_counts(A.register_cars(spark, sf))


def cars_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return listings.per_class(A.register_cars(spark, sf).withColumnRenamed("hash_id", "car_id"), A.wiki_cars(spark, sf), "car_id", "manufacturer")


def sensors_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return listings.per_class(statistics.with_fuel(A.sensors(spark, sf)), A.wiki_cars(spark, sf), "sensor_id", "manufacturer_raw", A.sensor_statistics(spark, sf))


def car_id_counts(spark: SparkSession, sf: str) -> DataFrame:
    return listings.car_id_counts(A.register_cars(spark, sf))


def car_id_rows(spark: SparkSession, sf: str) -> DataFrame:
    return listings.car_id_rows(A.register_cars(spark, sf))


def nested_ids(spark: SparkSession, sf: str) -> DataFrame:
    """car_ids by brand and model, as the numbers of ids of all and of each year."""
    ids = listings.nested_car_ids(listings.car_ids(A.register_cars(spark, sf)))
    by_year = F.transform(F.array_sort(F.map_entries("by_year")), lambda e: F.concat_ws(":", e["key"], F.size(e["value"]).cast("string")))
    return ids.select("brand", "model", F.size("all_ids").alias("n"), F.array_join(by_year, ",").alias("by_year"))


def cars_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """The page cars of each brand as a sorted list."""
    pages = A.wiki_cars(spark, sf).select("brand_name", "car_name", "category").distinct()
    out = listings.grouped(pages, "brand_name", sort=["car_name", "category"])
    return out.select("brand_name", F.array_join(F.transform("rows", lambda r: F.concat_ws("/", r["car_name"], r["category"])), ",").alias("cars"))


def cars_per_brand(spark: SparkSession, sf: str) -> DataFrame:
    out = listings.per_brand(A.register_cars(spark, sf).withColumnRenamed("hash_id", "car_id"), A.wiki_cars(spark, sf), "car_id", "manufacturer")
    return out.withColumn("categories", F.array_join("categories", ","))


def fleet_average(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(listings.fleet_means(_sensor_names(spark, sf), A.sensor_statistics(spark, sf)))


def funnel(spark: SparkSession, sf: str) -> DataFrame:
    return listings.funnel(_sensor_names(spark, sf), A.sensor_statistics(spark, sf))


# names and matching


def _brand_list(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()


def _part_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """For every brand the alias of its number: Brand#12 is also B12."""
    return _brand_list(spark, sf).select("brand", F.regexp_replace("brand", "Brand#", "B").alias("alias"), F.substring("brand", 7, 9).cast("int").alias("priority"))


def title_to_brand(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of page cars, by alias or brand, with a vehicle of its own and one that is ignored."""
    n = F.regexp_extract("hash_id", r"(\d)", 1).cast("int") % 3
    pages = A.wiki_cars(spark, sf)
    titles = pages.select(F.concat(F.when(n == 0, F.regexp_replace("brand_name", "Brand#", "b")).otherwise(F.col("brand_name")), F.lit(" "), F.when(n == 1, "-").otherwise(""), F.col("car_name")).alias("title"))
    vehicles = titles.filter(F.col("title").startswith("Brand#11 ")).select(F.col("title").alias("raw"), F.lit("Own").alias("brand"), F.col("title").alias("name"))
    ignored = titles.filter(F.col("title").startswith("Brand#2 ")).distinct()
    return B.title_to_car(titles, _part_aliases(spark, sf), _brand_list(spark, sf), vehicles, ignored)


def brand_names(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of register cars written in other ways."""
    k = F.col("p_partkey") % 4
    rows = A.table(spark, sf, "part").select("p_partkey", F.when(k == 0, F.upper("p_brand")).when(k == 1, F.concat(F.lit(" "), F.regexp_replace("p_brand", "Brand#", "b"))).when(k == 2, "").otherwise(F.col("p_brand")).alias("raw"))
    return B.normalized(rows, "raw", _part_aliases(spark, sf), _brand_list(spark, sf)).select("p_partkey", "raw", "brand")


def year_in_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.register_cars(spark, sf).select("hash_id", F.concat_ws(" ", "model", (F.col("year") - 30).cast("string"), F.lit("MY"), "year").alias("name"))
    return rows.select("hash_id", text.year_in_name(F.col("name"), 1999).alias("year"))


def clean_model(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("year") % 3
    named = F.when(k == 0, F.concat(F.col("model"), F.lit(", "), F.col("year").cast("string"))).when(k == 1, F.concat(F.col("model"), F.lit("MY"), F.col("year").cast("string"))).otherwise(F.concat(F.col("model"), F.lit(", my, x")))
    rows = A.register_cars(spark, sf).withColumn("named", named)
    return rows.select("hash_id", "named", text.clean_model(F.col("named"), F.col("year")).alias("cleaned"))


def number_parse(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, rest = (F.floor(cents / 100)).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    k = F.col("o_orderkey") % 4
    grouped = F.when(cents >= 100_000, F.concat_ws(".", F.floor(cents / 100_000).cast("string"), F.lpad((F.floor(cents / 100) % 1000).cast("string"), 3, "0"))).otherwise(whole)
    raw = F.when(k == 0, F.concat_ws(".", whole, rest)).when(k == 1, F.concat_ws(",", whole, rest)).when(k == 2, F.concat_ws(",", grouped, rest)).otherwise("x")
    rows = A.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return rounded(rows.select("o_orderkey", "raw", text.locale_number(F.col("raw")).alias("value")), 2)


def powerset(spark: SparkSession, sf: str) -> DataFrame:
    names = A.wiki_cars(spark, sf).select("car_name").distinct()
    return names.select("car_name", F.array_join(text.powerset(F.split("car_name", " ")), "|").alias("choices"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return tagger.dictionary(A.wiki_cars(spark, sf), _part_aliases(spark, sf))


def page_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of whole page texts, those that are about the page's car, and what is left of these without other names."""
    told = tagger.relevant_sentences(A.page_texts(spark, sf), _names(spark, sf))
    about = F.transform(F.filter("sentences", lambda s: s["relevant"]), lambda s: s["left"])
    return told.select("doc_id", "lang", F.size("sentences").alias("sentences"), F.size(about).alias("relevant"), F.md5(F.array_join(about, "|")).alias("left_md5"))


def page_names(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of each page text lie in names of brands and of other cars of its brand."""
    found = tagger.tagged(A.page_texts(spark, sf), _names(spark, sf))
    return found.filter(F.size("covered") > 0).select("doc_id", "brand", F.size("covered").alias("named_words"), F.md5(F.array_join("covered", ",")).alias("places_md5"))


def page_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of page cars with those from their texts."""
    found = matching.training_patterns(A.wiki_cars(spark, sf), _no_patterns(spark), A.page_texts(spark, sf), _part_aliases(spark, sf))
    return found.groupBy("brand", "tag").agg(F.count("*").alias("n"), F.min("pattern").alias("first_pattern"), F.max("pattern").alias("last_pattern"))


def _register_names(spark: SparkSession, sf: str) -> DataFrame:
    return A.register_cars(spark, sf).select(F.col("hash_id").alias("car_id"), F.col("manufacturer").alias("brand"), F.concat_ws(" ", "model", F.lower("description")).alias("name"), "year", "description")


def _curated(spark: SparkSession, sf: str) -> DataFrame:
    """A curated list: for the brands with an even number their first car's name with the type."""
    own = A.table(spark, sf, "part").filter((F.substring("p_brand", 7, 9).cast("int") % 2 == 0) & (F.col("p_type") == "PROMO"))
    return own.select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("entry"), F.concat_ws(" ", "p_brand", "p_name").alias("wiki_name")).distinct()


def match_register(spark: SparkSession, sf: str) -> DataFrame:
    found = matching.register_names(_register_names(spark, sf), A.wiki_cars(spark, sf), _curated(spark, sf))
    return found.per_car(F.count("*").alias("pages"), F.md5(F.array_join(F.array_sort(F.collect_set("hash_id")), ",")).alias("pages_md5"))


def match_sensor(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as owners of the part of their number."""
    part = A.table(spark, sf, "part")
    names = part.select(F.col("p_partkey").alias("car_id"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.upper("p_name")).alias("name"), F.lit(None).cast("int").alias("year"))
    return matching.sensor_names(names, A.wiki_cars(spark, sf), _curated(spark, sf)).per_car(F.count("*").alias("pages"))


def _review(spark: SparkSession, sf: str) -> DataFrame:
    """The queue when only curated matches and whole names count."""
    return matching.names_queue(matching.register_names(_register_names(spark, sf), A.wiki_cars(spark, sf), _curated(spark, sf))._replace(most=1))


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return _review(spark, sf).select("brand", "name", "cars", "matched", F.size("pages").alias("pages"))


def matched_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matching.accuracy(_review(spark, sf)))


def _distinct_names(spark: SparkSession, sf: str) -> DataFrame:
    return _register_names(spark, sf).select(F.md5(F.concat_ws("|", "brand", "name")).alias("car_id"), "brand", "name", F.lit(None).cast("int").alias("year")).distinct()


def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct register names and page names that share a word, and whether they are alike."""
    names = _distinct_names(spark, sf)
    pairs = matching.name_matches(names, A.wiki_cars(spark, sf)).select("car_id", "tag").join(names, "car_id")
    told = similarity.with_similarity(pairs, similarity.judgement(F.concat_ws(" ", "brand", "name"), F.col("tag")))
    return told.select("brand", "name", F.col("tag").alias("page"), "alike")


def classifier_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier for each brand from the words of its pages' names to the pages, asked about distinct register names."""
    none = spark.createDataFrame([], "brand string, tag string, polarity string, pattern string")
    model = matching.train(matching.training_patterns(A.wiki_cars(spark, sf), none))
    texts = _distinct_names(spark, sf).select("car_id", "brand", F.col("name").alias("text"))
    return rounded(matching.scores(model, texts).select("brand", "text", "tag", "score"))


def accepted_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates by common words, accepted by the rules."""
    named = _distinct_names(spark, sf)
    scored = matching.name_matches(named, A.wiki_cars(spark, sf)).join(named, "car_id")
    return matching.accepted(scored, A.wiki_cars(spark, sf), _part_aliases(spark, sf), required=0.8).groupBy("car_id", "rule").agg(F.count("*").alias("pages"))


def keyed_measurements(spark: SparkSession, sf: str) -> DataFrame:
    """The load of measurements: their stored columns and key."""
    from ..sources.loads import load

    rows = load("track_measurement", A.measurements(spark, sf))
    return rows.groupBy("phenomenon").agg(F.count("*").alias("rows"), F.countDistinct("hash_id").alias("keys"), F.min("hash_id").alias("first_key"))


def newest_measurement(spark: SparkSession, sf: str) -> DataFrame:
    """The first row in a stated order: each sensor's latest value."""
    rows = readers.newest_first(A.measurements(spark, sf), ["sensor_id"], [F.desc("date"), F.asc("track_measurement_id")])
    return rows.select("sensor_id", "track_measurement_id", "phenomenon", "phenomenon_value")


# more of matching


def _no_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "brand string, tag string, polarity string, pattern string")


def _model(spark: SparkSession, sf: str) -> matching.Classifier:
    """The classifiers of all brands from their pages' names, as stored tables."""
    model = matching.train(matching.training_patterns(A.wiki_cars(spark, sf), _no_patterns(spark)))
    return matching.Classifier(sinks.kept(model.tags, "model-tags"), sinks.kept(model.gains, "model-gains"))


def _ask(spark: SparkSession, sf: str):
    model = _model(spark, sf)
    return lambda texts: matching.scores(model, texts)


def _networks(spark: SparkSession, sf: str) -> DataFrame:
    """The networks of all brands from their pages' names, as a stored table."""
    return sinks.kept(network.train(matching.training_patterns(A.wiki_cars(spark, sf), _no_patterns(spark))), "brand-networks")


def match_register_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Register cars by the classifier's pages of their names, with the back-off, without the rules on similarity."""
    wiki, ask = A.wiki_cars(spark, sf), _ask(spark, sf)
    found = matching.register_names_scored(_register_names(spark, sf), wiki, _curated(spark, sf), ask, _part_aliases(spark, sf), required=0.4, complex_rules=False)
    return found.per_car(F.count("*").alias("pages"))


def match_sensor_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' cars, by the classifier of each brand and the whole cascade of rules."""
    wiki, names = A.wiki_cars(spark, sf), _sensor_cars(spark, sf)
    found = matching.sensor_names_scored(names, wiki, _curated(spark, sf), _ask(spark, sf), _part_aliases(spark, sf), required=0.9)
    return found.per_car(F.count("*").alias("pages"))


def _sensor_cars(spark: SparkSession, sf: str) -> DataFrame:
    named = F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("car_id"), F.col("p_brand").alias("brand"), named, (F.lit(1990) + F.col("p_partkey") % 30).cast("int").alias("year"))


def network_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A network for each brand, asked about the names that it was trained on: the page that it puts first, and whether surely."""
    wiki = A.wiki_cars(spark, sf).select(F.col("wiki_name").alias("car_id"), F.col("brand_name").alias("brand"), F.col("car_name").alias("text")).distinct()
    found = network.scores(_networks(spark, sf), wiki, keep=1)
    return found.select("car_id", "brand", "text", "tag", (F.col("score") >= matching.REGISTER_SCORE).alias("sure"))


def match_register_network(spark: SparkSession, sf: str) -> DataFrame:
    """Register cars by the network of their brand and all rules, at the score that the register requires."""
    networks = _networks(spark, sf)
    found = matching.register_names_scored(_register_names(spark, sf), A.wiki_cars(spark, sf), _curated(spark, sf), lambda texts: network.scores(networks, texts), _part_aliases(spark, sf))
    return found.per_car(F.count("*").alias("pages"))


def match_sensor_network(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' cars by the network of their brand and all rules, at the score that sensors require."""
    networks = _networks(spark, sf)
    found = matching.sensor_names_scored(_sensor_cars(spark, sf), A.wiki_cars(spark, sf), _curated(spark, sf), lambda texts: network.scores(networks, texts), _part_aliases(spark, sf))
    return found.per_car(F.count("*").alias("pages"))


def accepted_by_score(spark: SparkSession, sf: str) -> DataFrame:
    """The rules that don't compare strings, on pairs that share a word: the score itself, and the band below it."""
    named = _distinct_names(spark, sf)
    scored = matching.name_matches(named, A.wiki_cars(spark, sf)).join(named, "car_id")
    found = matching.accepted(scored, A.wiki_cars(spark, sf), _part_aliases(spark, sf), required=0.8).filter("rule <= 2")
    return found.groupBy("car_id", "rule").agg(F.count("*").alias("pages"))


def candidate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is asked about each distinct page car: brand or alias with each choice of its words."""
    cars = A.wiki_cars(spark, sf).select(F.md5(F.concat_ws("|", "brand_name", "car_name")).alias("car_id"), F.col("brand_name").alias("brand"), F.concat("car_name", F.lit(" 1999")).alias("name")).distinct()
    return matching.candidate_texts(cars, _part_aliases(spark, sf)).groupBy("car_id", "brand").agg(F.count("*").alias("texts"), F.min("text").alias("first_text"), F.max("text").alias("last_text"))


def contained_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose names are choices of the words of register names, written with a year, the type twice and their words apart."""
    k = F.length("name") % 2 == 0
    name = F.concat_ws(" ", F.when(k, F.upper("name")).otherwise(F.col("name")), F.lit("2003"), F.reverse(F.split("name", " "))[0], "name")
    found = matching.contained_pages(_distinct_names(spark, sf).withColumn("name", name), A.wiki_cars(spark, sf))
    return found.groupBy("car_id", "brand").agg(F.count("*").alias("pages"), F.min("tag").alias("first_page"), F.max("tag").alias("last_page"))


def training_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of page cars, with labelled ones: their types, and one casing of some names that is wrong."""
    part = A.table(spark, sf, "part")
    right = part.select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_brand", "p_name").alias("tag"), F.lit("positive").alias("polarity"), F.lower("p_type").alias("pattern"))
    wrong = part.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_brand", "p_name").alias("tag"), F.lit("negative").alias("polarity"), F.upper("p_name").alias("pattern"))
    both = matching.merged_patterns(right.unionByName(wrong), wrong)
    return matching.training_patterns(A.wiki_cars(spark, sf), both).groupBy("brand", "tag").agg(F.count("*").alias("n"), F.min("pattern").alias("first_pattern"), F.max("pattern").alias("last_pattern"))


def verdict_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed page cars as labelled patterns."""
    rows = A.wiki_cars(spark, sf).select(F.col("brand_name").alias("brand"), F.col("wiki_name").alias("name"), F.col("wiki_name").alias("tag"), (F.length("car_name") % 2 == 0).alias("right")).distinct()
    return matching.verdict_patterns(rows).groupBy("brand", "tag", "polarity").agg(F.count("*").alias("n"), F.min("pattern").alias("first_pattern"), F.max("pattern").alias("last_pattern"))


def match_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that link register cars to pages, as numbers and keys by car."""
    rows = A.register_cars(spark, sf).select(F.col("hash_id").alias("car_id"), F.explode("wiki_hashes").alias("hash_id"))
    return matching.bridge(rows).groupBy("car_id").agg(F.count("*").alias("n"), F.min("object_hash").alias("first_key"))


# names, words and numbers


def loose_brand_names(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of makers' names: an alias that contains what is asked counts."""
    brands = _brand_list(spark, sf)
    number = F.substring("brand", 7, 9).cast("int")
    aliases = brands.select("brand", F.concat(F.lit("Maker "), number.cast("string"), F.lit(" Works")).alias("alias"), number.alias("priority"))
    k = F.col("p_partkey") % 3
    rows = A.table(spark, sf, "part").select("p_partkey", F.when(k == 0, F.concat(F.lit(" maker "), F.substring("p_brand", 7, 1))).when(k == 1, F.upper("p_brand")).otherwise("nobody").alias("raw"))
    return B.normalized_loosely(rows, "raw", aliases, brands).select("p_partkey", "raw", "brand")


def rewritten_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """Sensors by a dictionary that has one maker, one maker with model, and one model."""
    rows = A.sensors(spark, sf).select("sensor_id", text.stripped(F.col("manufacturer_raw")).alias("manufacturer"), F.col("car_model").alias("model"))
    words = spark.createDataFrame([("BUILDING", "Builders", None), ("automobile MODEL 7", "Auto", "Seven"), ("model 9", None, "Nine")], "raw string, brand string, name string")
    return sensors.rewritten(rows, words)


def unique_cars(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.register_cars(spark, sf).select(F.col("hash_id").alias("car_id"), F.col("manufacturer").alias("brand"), F.col("model").alias("name"), F.when(F.col("year") % 2 == 0, F.col("year")).alias("year"), "description")
    return names.unique_cars(rows).select("brand", "unique_name", "car_id")


def in_word_list(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have one of the long words of the benchmark's items."""
    words = A.table(spark, sf, "benchmark").select(F.explode(text.words(F.col("text"))).alias("word")).filter("length(word) >= 14").distinct()
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    return names.in_word_list(docs, "text", words).select("doc_id")


def latest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The three dearest orders of each customer."""
    return names.top_per_group(A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def point_prices(spark: SparkSession, sf: str) -> DataFrame:
    p = A.country_prices(spark, sf)
    points = _requests(spark, sf).select(F.col("request_id").alias("route"), F.posexplode("coordinates").alias("seq", "c")).select("route", "seq", "c.x", "c.y")
    out = names.point_prices(points, A.countries(spark, sf), p, prices.mean_over_countries(p), 0.07, "diesel")
    return out.select("route", "seq", F.coalesce("country", F.lit("-")).alias("country"), F.round("meters", 2).alias("meters"), F.round("price", 4).alias("price"), F.round("cost", 3).alias("cost"))


def plain_names(spark: SparkSession, sf: str) -> DataFrame:
    """Page cars' names without marks, brackets and repeated words, and capitalised."""
    raw = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")-X/"), F.col("p_name"))
    rows = A.table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    r = F.col("raw")
    return rows.select("p_partkey", text.punctuation_to_blank(r).alias("no_marks"), text.without_brackets(r).alias("no_brackets"), text.without_repeats(r).alias("no_repeats"), text.capitalized(F.upper(r)).alias("capital"), text.before_single_comma(F.concat(r, F.lit(", z"))).alias("before_comma"))


def speed_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Consumption at speeds in and out of each sensor model's range: the parabola, straight lines outside, cut decimals."""
    m = _sensor_models(spark, sf).withColumn("v", F.explode(F.array(*[F.lit(x) for x in (-20.0, 10.0, 90.0, 400.0)])))
    args = (F.col("v"), F.lit(0.0), F.col("cons_min"), F.col("speed_average"), F.col("cons_average"), F.col("speed_max"), F.col("cons_max"))
    line = maths.linear_outside(*args)
    return m.select("category", "fuel_type", "v", F.round(maths.parabola(*args), 4).alias("parabola"), F.round(line, 4).alias("linear"), maths.truncated(F.round(line, 6), 1).alias("cut"), F.round(maths.capped_co2(F.abs(line) * 1000, F.col("fuel_type")), 4).alias("capped"))


# scans and loads


def older_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The older history as a sheet of texts with serial dates, of known countries only."""
    p = A.country_prices(spark, sf)
    serial = F.datediff("date", F.lit("1899-12-30").cast("date")).cast("string")
    sheet = p.select(F.col("country").alias("code"), F.when(F.month("date") != 2, serial).otherwise("note").alias("serial"), F.lit("1").alias("taux"), F.lit("").alias("euro_price"), F.col("euro_ttc").cast("string").alias("euro"), F.lit("x").alias("diesel"))
    known = A.countries(spark, sf).select(F.col("country").alias("country_alpha_2"), F.lit(None).cast("string").alias("country_alpha_3"))
    return rounded(readers.price_rows(sheet, known))


def general_sheet(spark: SparkSession, sf: str) -> DataFrame:
    mean = prices.mean_over_countries(A.country_prices(spark, sf))
    sheet = mean.select(F.datediff("date", F.lit("1904-01-01").cast("date")).cast("string").alias("serial"), F.col("euro_ttc").cast("string").alias("euro"), F.when(F.month("date") > 6, F.col("diesel_ttc").cast("string")).alias("diesel"))
    return rounded(readers.general_prices(sheet, 1).select("date", "euro_super_95", "diesel"))


def category_members(spark: SparkSession, sf: str) -> DataFrame:
    """Listings of a class's pages, in two languages."""
    pages = A.wiki_cars(spark, sf)
    head = F.concat(F.when(F.length("category") == 1, "Category:").otherwise("Kategorie:"), F.col("category"))
    listing = pages.groupBy(head.alias("category")).agg(F.collect_list("wiki_name").alias("members"))
    return readers.category_members(listing)


def missing_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts of documents out of JSON answers, for those without a stored one."""
    key = F.md5(F.col("doc_id").cast("string")).alias("hash_id")
    docs = A.table(spark, sf, "documents").filter("doc_id is not null")
    stored = docs.filter("doc_id % 3 = 0").select(key, F.col("text").alias("page_text"))
    body = F.to_json(F.struct(F.struct(F.struct(F.col("text").alias("extract")).alias("7")).alias("query")))
    found = readers.missing_texts(docs.select(key), stored, docs.select(key, body.alias("body")))
    return found.select("hash_id", F.md5("page_text").alias("text_md5"))


def register_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The register written as its CSV, in Windows' encoding, and scanned: measures by their means."""
    path = sinks.scratch(spark, "register")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    cars = A.register_cars(spark, sf)
    named = {h: c for h, c in readers.REGISTER_COLUMNS.items() if c in cars.columns}
    rows = cars.select(F.concat(F.col("manufacturer"), F.lit(" \u00e9")).alias("Manufacturer"), *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(h) for h, c in named.items() if c != "manufacturer"], F.concat(F.lit("3 March "), F.col("year").cast("string")).alias("Date of change"))
    rows.write.csv(path, header=True, encoding="windows-1252")
    read = readers.register(spark, path, 2000)
    means = [F.avg(m).alias(f"mean_{m}") for m in statistics.measures_of(read)]
    return rounded(read.groupBy("manufacturer", "fuel_type").agg(F.count("*").alias("cars"), F.min("year").alias("first_year"), *means), 3)


def boundary_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Countries written as lines of GeoJSON, scanned, and met by code."""
    path = sinks.scratch(spark, "boundaries")
    c = A.countries(spark, sf)
    line = F.transform("polygons", lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    shape = F.struct(F.struct(F.col("country").alias("iso_a2")).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), line.alias("coordinates")).alias("geometry"))
    c.select(F.to_json(shape).alias("value")).write.text(path)
    codes = c.select(F.col("country").alias("country_alpha_2"), F.lit(None).cast("string").alias("country_alpha_3"), "name")
    met = readers.with_boundaries(codes, readers.boundaries(spark, path)).withColumnRenamed("country_alpha_2", "country")
    e = spatial.edges(met)
    return e.groupBy("country").agg(F.count("*").alias("edges"), F.min("ax").alias("x0"), F.max("by").alias("y1"))


def track_page_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements written as pages of tracks and scanned: values by phenomenon."""
    path = sinks.scratch(spark, "pages")
    m = A.measurements(spark, sf)
    value = F.struct(F.col("phenomenon_value").alias("value"), F.lit("u").alias("unit"))
    feature = F.struct(F.struct(F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")).alias("geometry"), F.struct(F.col("track_measurement_id").cast("string").alias("id"), F.col("date").alias("time"), F.create_map("phenomenon", value).alias("phenomenons")).alias("properties"))
    page = m.groupBy("track_id", "sensor_id").agg(F.collect_list(feature).alias("features"))
    props = F.struct(F.col("track_id").cast("string").alias("id"), F.struct(F.struct(F.col("sensor_id").cast("string").alias("id")).alias("properties")).alias("sensor"))
    page.select(F.to_json(F.struct(props.alias("properties"), "features")).alias("value")).write.text(path)
    points, values = readers.track_features(spark.read.schema(readers.FEATURES).json(path))
    out = values.groupBy("phenomenon").agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"), F.countDistinct("sensor_id").alias("sensors"), F.sum("phenomenon_value").alias("total"), F.max("date").cast("date").alias("last_day"))
    return rounded(out.join(F.broadcast(points.agg(F.count("*").alias("points"))), F.lit(True), "left"), 3)


def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as CSV and as JSON documents, and both read again."""
    path = sinks.scratch(spark, "report")
    rows = A.country_prices(spark, sf).select("country", F.col("date").cast("string").alias("date"), "euro_ttc")
    sinks.write_csv(rows, f"{path}-csv")
    sinks.write_json_documents(rows, f"{path}-json")
    schema = "country string, date string, euro_ttc double"
    both = spark.read.csv(f"{path}-csv", header=True, schema=schema).select(F.lit("csv").alias("kind"), "*").unionByName(spark.read.schema(schema).json(f"{path}-json").select(F.lit("json").alias("kind"), "*"))
    return rounded(both, 3)


def stored_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Prices merged into a stored table twice, the second time with some that changed, and read again."""
    path = sinks.scratch(spark, "prices")
    p = A.country_prices(spark, sf).select("country", "date", "euro_ttc")
    schema = "country string, date date, euro_ttc double"
    sinks.upsert_table(spark, path, p, schema, "country", "date")
    sinks.upsert_table(spark, path, p.filter("month(date) = 3").withColumn("euro_ttc", F.col("euro_ttc") + 1), schema, "country", "date")
    return rounded(sinks.read_table(spark, path, schema), 3)


def streamed_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements that come as files, in two runs of the stream; the table that it keeps up."""
    from ..streaming import ingest

    path = sinks.scratch(spark, "stream")
    rows = A.measurements(spark, sf).select(F.col("sensor_id").cast("string").alias("sensor_id"), "phenomenon", "phenomenon_value")
    for part in range(2):
        rows.filter(F.pmod(F.hash("sensor_id", "phenomenon_value"), F.lit(2)) == part).write.mode("append").parquet(f"{path}/in")
        ingest.running_statistics(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/mark").awaitTermination()
    return rounded(sinks.read_table(spark, f"{path}/out", ingest.STATE), 3)


def loaded_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The load of sensor statistics: its columns, the clamp and the key."""
    from ..sources.loads import load

    rows = load("sensor_statistic", A.sensor_statistics(spark, sf))
    return rounded(rows.select("hash_id", "sensor_id", "phenomenon", "max", "avg", "min", "numb_measurements"), 8)


def loaded_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and distinct keys of the loads of tracks, pages, register cars and prices."""
    from ..sources.loads import load

    tables = {"track": (A.tracks(spark, sf), "track_id"), "wiki_car": (A.wiki_cars(spark, sf).drop("hash_id"), "hash_id"), "register_car": (A.register_cars(spark, sf), "hash_id"), "country_price": (A.country_prices(spark, sf), "hash_id")}
    out = None
    for kind, (rows, key) in tables.items():
        one = load(kind, rows).agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


def inserted_prices(spark: SparkSession, sf: str) -> DataFrame:
    """What an insert of all prices, each twice, would add to those of odd months."""
    p = A.country_prices(spark, sf).select("country", "date", "euro_ttc")
    return rounded(sinks.inserted(p.filter("month(date) % 2 = 1"), p.unionByName(p), "country", "date"), 3)


def updated_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Register cars of even years with other matches: their first page alone."""
    cars = A.register_cars(spark, sf).select("hash_id", "year", "wiki_hashes")
    new = cars.filter("year % 2 = 0").select("hash_id", F.slice("wiki_hashes", 1, 1).alias("wiki_hashes"))
    return sinks.updated_matches(cars, new).groupBy("year").agg(F.count("*").alias("cars"), F.sum(F.size("wiki_hashes")).alias("pages"))


def near_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of routes within 180 km of the one before."""
    points = _requests(spark, sf).select(F.col("request_id").alias("route"), F.posexplode("coordinates").alias("seq", "c")).select("route", "seq", "c.x", "c.y")
    far = spatial.point_distances(points)
    return far.filter(spatial.within_limit(F.col("meters") / 1000, 180.0)).groupBy("route").agg(F.count("*").alias("n"))


# stored tables and streams


def stored_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as a table of appended batches: all of them, a month deleted and another one changed, a compaction, and more changes."""
    path, schema, keys = sinks.scratch(spark, "changes"), "country string, date date, euro_ttc double", ["country", "date"]
    p = A.country_prices(spark, sf).select("country", "date", "euro_ttc")
    tables.append(spark, path, p, schema, keys)
    tables.append(spark, path, p.filter("month(date) = 2"), schema, keys, gone=True)
    tables.append(spark, path, p.filter("month(date) in (3, 5)").withColumn("euro_ttc", F.col("euro_ttc") + 1), schema, keys)
    tables.compact(spark, path, schema)
    tables.append(spark, path, p.filter("month(date) = 5 or (month(date) = 2 and year(date) > 1995)").withColumn("euro_ttc", F.col("euro_ttc") + 2), schema, keys)
    tables.vacuum(spark, path)
    return rounded(tables.read(spark, path, schema), 3)


def _measurement_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import ingest

    types = dict(f.split() for f in ingest.VALUES.split(", "))
    return A.measurements(spark, sf).select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def stored_once(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements that come in three files which overlap, some without an id, by two checkpoints: each is stored once."""
    from ..streaming import ingest

    path, k = sinks.scratch(spark, "once"), F.col("track_measurement_id").cast("long")
    rows = _measurement_rows(spark, sf).withColumn("date", F.when(k % 10 != 3, F.col("date")))
    nameless = rows.filter(k % 500 == 1).withColumn("track_measurement_id", F.lit(None).cast("string"))
    for part, mark in ((rows.filter(k % 3 < 2), "a"), (rows.filter(k % 3 > 0).unionByName(nameless), "a"), (nameless, "b")):
        part.write.mode("append").parquet(f"{path}/in")
        ingest.append(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/{mark}").awaitTermination()
    stored = spark.read.schema(f"{ingest.VALUES}, {ingest.LOAD} string, {ingest.DAY} string").parquet(f"{path}/out")
    return stored.groupBy("phenomenon").agg(F.count("*").alias("n"), F.count("track_measurement_id").alias("named"), F.countDistinct("track_measurement_id").alias("ids"), F.count_if(F.col("day") == "none").alias("undated"))


def corrected_measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of sensors after measurements were corrected, moved to another phenomenon's sensor, and deleted."""
    from ..streaming import ingest

    path, k = sinks.scratch(spark, "corrected"), F.col("track_measurement_id").cast("long")
    rows = _measurement_rows(spark, sf).withColumns({"changed": F.lit(1), "deleted": F.lit(False)})
    value = F.col("phenomenon_value")
    moved = rows.filter(k % 7 == 0).withColumns({"phenomenon_value": F.when(k % 2 == 0, value + 10).otherwise(value), "sensor_id": F.when(k % 3 == 0, F.lit("1")).otherwise(F.col("sensor_id")), "changed": F.lit(2)})
    gone = rows.filter(k % 11 == 0).withColumns({"deleted": F.lit(True), "changed": F.lit(3)})
    for part in (rows, moved.unionByName(gone)):
        part.write.mode("append").parquet(f"{path}/in")
        ingest.corrected_statistics(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/values", f"{path}/counts", f"{path}/stats", f"{path}/mark").awaitTermination()
    return rounded(tables.read(spark, f"{path}/stats", ingest.STATE), 3)
