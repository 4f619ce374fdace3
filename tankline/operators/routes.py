"""Route requests: validation and defaults, part prices, fuel models by speed, and costs with the tank carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import BASE_SPEED, capped_co2, co2_growth, fuel_growth, parabola
from ..functions.text import FIRST_YEAR
from .prices import latest
from .spatial import metric_lengths, overlay, unsized
from .statistics import REGISTER_MEASURES, reported_cars

# Vehicle classes (code, English name, German name, tank in litres), speeds of driving styles, error codes.
CATEGORIES = [
    ("a", "mini cars", "Kleinstwagen", 15), ("b", "small cars", "Kleinwagen", 45), ("c", "medium cars", "Mittelklasse", 55), ("d", "large cars", "Obere Mittelklasse", 55),
    ("e", "executive cars", "Oberklasse", 55), ("f", "luxury cars", "Luxusklasse", 55), ("s", "sport coupés", "Sportwagen", 40), ("m", "MiniVaN - multi purpose cars", "Van", 80),
    ("j", "SUV", "SUV", 100), ("pu", "Pick-up", "Pick-up", 100), ("lcv", "Utilities", "Nutzfahrzeuge", 80), ("individual", "Individual", "Individuell", 40),
]
STYLE_SPEED = {"moderate": 70, "fast": 90}
FUELS = ("gasoline", "diesel")
NO_JSON, NO_FILTERS, NO_GEOMETRY, NO_FUEL, NO_GEOJSON, BAD_GEOJSON, NO_SOURCE = 4000, 4001, 4002, 4003, 4005, 4007, 4009

REQUEST_SCHEMA = (
    "request string, geometry struct<geojson:struct<type:string,coordinates:array<array<double>>>, filters:struct<data_source:string,fuel_type:string,vehicle_type:string,"
    "driving_style:string,driving_speed:int,vehicle_categories:array<string>,tank_sizes:map<string,int>,fuel_consumptions:map<string,double>,cfd_ids:array<string>,year:int,request_id:string>>"
)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category string, category_en string, category_de string, tank int")


def parsed(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Request bodies (request_id, JSON text) as typed requests with an error_code, null for a valid one. The first thing
    that is wrong gives the code; invalid requests stay as rows."""
    r = F.from_json(F.col(column), REQUEST_SCHEMA)
    g, f = F.col("_r.geometry"), F.col("_r.geometry.filters")
    points = F.col("_r.geometry.geojson.coordinates")
    bad_line = (F.col("_r.geometry.geojson.type") != "LineString") | F.col("_r.geometry.geojson.type").isNull() | (F.coalesce(F.size(points), F.lit(0)) < 2) | F.exists(points, lambda p: (F.size(p) < 2) | F.coalesce(p[0], p[1]).isNull())
    code = (
        F.when(F.col("_r").isNull() | F.coalesce(F.col("_r.request") != "route", F.lit(True)), NO_JSON).when(g.isNull(), NO_GEOMETRY).when(f.isNull(), NO_FILTERS)
        .when(F.coalesce(~(f["data_source"].contains("cfd") | f["data_source"].contains("ec")), F.lit(True)), NO_SOURCE).when(f["fuel_type"].isNull(), NO_FUEL)
        .when(g["geojson"].isNull(), NO_GEOJSON).when(F.coalesce(bad_line, F.lit(True)), BAD_GEOJSON)
    )
    out = bodies.withColumn("_r", r)
    names = ("data_source", "fuel_type", "vehicle_type", "driving_style", "driving_speed", "vehicle_categories", "tank_sizes", "fuel_consumptions", "cfd_ids", "year")
    line = F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return out.select("request_id", code.alias("error_code"), line.alias("coordinates"), *[f[n].alias(n) for n in names])


_OPTIONAL = {
    "data_source": "string", "fuel_type": "string", "vehicle_type": "string", "driving_style": "string", "driving_speed": "int", "vehicle_categories": "array<string>",
    "tank_sizes": "map<string,int>", "fuel_consumptions": "map<string,double>", "cfd_ids": "array<string>", "year": "int",
}


def with_defaults(requests: DataFrame) -> DataFrame:
    """Requests with every column there is, defaults for what is null, and v, the speed: the one asked for, else that of
    the style."""
    out = requests.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in requests.columns})
    fill = {"data_source": "cfd", "fuel_type": "gasoline", "vehicle_type": "car", "driving_style": "moderate"}
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(x)) for c, x in fill.items()})
    out = out.withColumn("vehicle_categories", F.coalesce("vehicle_categories", F.array(F.lit("all"))))
    style = F.when(F.col("driving_style") == "fast", STYLE_SPEED["fast"]).otherwise(STYLE_SPEED["moderate"])
    return out.withColumn("v", F.coalesce(F.col("driving_speed"), style).cast("double"))


def priced_parts(requests: DataFrame, countries: DataFrame, prices: DataFrame, general: DataFrame, cell: float = 1.0) -> DataFrame:
    """(request_id, country, km, date and prices per litre): the length of each line in each country, with the country's
    latest price; what lies in no country, or in one without a price, has the latest price for all, and comes last."""
    lengths = metric_lengths(overlay(requests, countries, cell), "request_id", "country")
    own = latest(prices, "country")
    fields = ["date", "euro_ttc", "euro_ht", "diesel_ttc", "diesel_ht"]
    everywhere = latest(general).select(*[F.col(c).alias(f"g_{c}") for c in fields])
    joined = lengths.join(own, "country", "left").join(F.broadcast(everywhere), F.lit(True), "left")  # one row
    rest = F.col("euro_ttc").isNull() & F.col("diesel_ttc").isNull()
    return joined.select("request_id", "country", (F.col("meters") / 1000).alias("km"), rest.cast("int").alias("last"), *[F.when(rest, F.col(f"g_{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def parts_of_requests(parts: DataFrame) -> DataFrame:
    """One row for each request with its parts in the order they are driven through: by price date, the latest first, then
    country; the remainder last. A line has as many parts as countries, and one."""
    key = F.struct("last", F.negate(F.unix_date("date")).alias("newest"), "country", "km", "date", "euro_ttc", "euro_ht", "diesel_ttc", "diesel_ht")
    return parts.groupBy("request_id").agg(F.sum("km").alias("km"), F.array_sort(F.collect_list(key)).alias("parts"))


_STATE = "struct<left:double,prev_ttc:double,prev_ht:double,started:boolean,ttc:double,ht:double,litres:double,date:date>"


def carried_cost(parts: Column, litres_per_km: Column, tank: Column, fuel: Column, whole_tanks: bool) -> Column:
    """(ttc, ht, litres, date): fuel is bought part by part; what is left from an earlier part is used first, at the price
    paid for it, and the rest is filled up here.

    whole_tanks: full tanks are bought, which leaves fuel for the next part; else amounts to five decimals of a tank,
    which leave next to none. Fuels but gasoline and diesel cost nothing.
    """
    price = lambda p, end: F.when(fuel == "gasoline", p[f"euro_{end}"]).when(fuel == "diesel", p[f"diesel_{end}"]).otherwise(F.lit(0.0))

    def part(s: Column, p: Column) -> Column:
        used = s["left"] > 0
        total = litres_per_km * p["km"]
        need = F.when(used, total - s["left"]).otherwise(total)
        before = {e: F.when(s["started"], s[f"prev_{e}"]).otherwise(price(p, e)) for e in ("ttc", "ht")}
        tanks = F.ceil(need / tank) if whole_tanks else F.round(need / tank, 5)
        left = tank * tanks - (need if whole_tanks else total)
        paid = {e: s[e] + F.when(used, before[e] * s["left"]).otherwise(0.0) + price(p, e) * need for e in ("ttc", "ht")}
        after = {e: F.when(used, price(p, e)).otherwise(before[e]) for e in ("ttc", "ht")}
        return F.struct(
            F.greatest(left, F.lit(0.0)).cast("double").alias("left"), after["ttc"].cast("double").alias("prev_ttc"), after["ht"].cast("double").alias("prev_ht"), F.lit(True).alias("started"),
            paid["ttc"].cast("double").alias("ttc"), paid["ht"].cast("double").alias("ht"), (s["litres"] + total).cast("double").alias("litres"), p["date"].alias("date"),
        ).cast(_STATE)

    start = F.struct(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(None).cast("date")).cast(_STATE)
    return F.aggregate(parts, start, part)


def _curve(v: Column, what: str) -> Column:
    """Consumption in l/h or CO2 in kg/h of a sensor model at speed v."""
    return parabola(v, F.lit(0.0), F.col(f"{what}_min"), F.col("speed_average"), F.col(f"{what}_average"), F.col("speed_max"), F.col(f"{what}_max"))


def growth_factors(models: DataFrame, v: Column) -> DataFrame:
    """Sensor models with g_fuel and g_co2, how their litres and CO2 per km change from the base speed to v."""
    base, dest = F.lit(float(BASE_SPEED)), F.floor(v).cast("double")
    return models.withColumns({"g_fuel": fuel_growth(_curve(base, "cons"), base, _curve(dest, "cons"), dest), "g_co2": co2_growth(_curve(base, "co2"), base, _curve(dest, "co2"), dest)})


def _chosen(requests: DataFrame) -> DataFrame:
    """A row for each request and class it asks for, with the tank and the manual consumption. The classes are a constant
    array that is exploded, so that no join is needed for them."""
    asked = F.array_contains("vehicle_categories", "all") | F.expr("array_contains(vehicle_categories, category)")
    tank = F.coalesce(F.try_element_at("tank_sizes", F.col("category")), F.col("tank")).cast("double")
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("category", "category_en", "category_de", "tank"))]) for c in CATEGORIES if c[0] != "individual"])
    out = requests.select("*", F.inline(listed)).filter(asked)
    return out.withColumns({"tank": tank, "manual": F.try_element_at("fuel_consumptions", F.col("category"))})


def _finished(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the cost; null figures and an error note where the model is missing something."""
    return df.withColumn("calculation_errors", F.when(F.col("litre_per_km").isNull(), F.lit("not enough data"))).select(*names, "calculation_errors")


_HEAD = ["request_id", "category", "category_en", "category_de", "fuel_type"]


def sensor_costs(requests: DataFrame, parts: DataFrame, sensor_models: DataFrame) -> DataFrame:
    """The cost of each request in each class it asks for, by sensors' models. parts as parts_of_requests has them."""
    chosen = _chosen(with_defaults(requests)).drop("coordinates")
    rows = chosen.join(sensor_models, ["category", "fuel_type"], "left").join(unsized(parts), "request_id")
    v = F.col("v")
    rows = rows.withColumns({
        "litre_per_km": F.coalesce(F.when(F.col("measurements").isNotNull(), F.col("manual") / 100), F.try_divide(_curve(v, "cons"), v)),
        "co2_per_km": F.try_divide(_curve(v, "co2"), v) * 1000,
    })
    rows = rows.withColumn("c", carried_cost(F.col("parts"), F.col("litre_per_km"), F.col("tank"), F.col("fuel_type"), True))
    figures = {
        "manual_consumption": F.col("manual").isNotNull(), "ec_sensors": F.col("numb_sensors"), "ec_measurements": F.col("measurements"), "km": F.bround("km", 6), "liters": F.bround("c.litres", 3),
        "co2_kg": F.bround(F.col("km") * F.col("co2_per_km") / 1000, 6), "w_tax_euro": F.bround("c.ttc", 2), "wo_tax_euro": F.bround("c.ht", 2), "price_date": F.date_format("c.date", "yyyy-MM-dd'T'HH:mm:ss"),
        "liter_per_100km": F.bround(F.col("litre_per_km") * 100, 1), "co2_gram_per_km": F.bround("co2_per_km", 6),
        "co2_gram_per_liter": F.bround(capped_co2(F.try_divide(F.col("co2_per_km"), F.col("litre_per_km")), F.col("fuel_type")), 6),
    }
    return _finished(rows.withColumns(figures), [*_HEAD, *figures])


_POLLUTANTS = {"co": "emissions_co_mg_per_km", "nox": "emissions_nox_mg_per_km", "thc": "thc_emissions_mg_per_km"}


def _register_rates(manual: Column) -> dict[str, Column]:
    """Per km, at the growth factors' speed; null where one of the five measures is missing."""
    full = F.lit(True)
    for m in REGISTER_MEASURES:
        full = full & F.col(m).isNotNull()
    up = lambda c, g: F.when(full, F.col(c) * (1 + F.col(g)))
    litre = F.when(full, F.coalesce(manual, F.col("metric_combined")) / 100 * (1 + F.col("g_fuel")))
    return {"litre_per_km": litre, "co2_per_km": up("co2_g_per_km", "g_co2"), **{f"{k}_per_km": up(m, "g_fuel") for k, m in _POLLUTANTS.items()}}


def _register_figures(km: Column) -> dict[str, Column]:
    per_litre = lambda k: F.bround(F.try_divide(F.col(f"{k}_per_km"), F.col("litre_per_km")), 6)
    out = {"km": F.bround(km, 6), "liters": F.bround("c.litres", 2), "w_tax_euro": F.bround("c.ttc", 2), "wo_tax_euro": F.bround("c.ht", 2), "price_date": F.date_format("c.date", "yyyy-MM-dd'T'HH:mm:ss"), "liter_per_100km": F.bround(F.col("litre_per_km") * 100, 1)}
    out |= {"co2_kg": F.bround(km * F.col("co2_per_km") / 1000, 6), "co2_gram_per_km": F.bround("co2_per_km", 6), "co2_gram_per_liter": per_litre("co2")}
    for k in _POLLUTANTS:
        out |= {f"{k}_g": F.bround(km * F.col(f"{k}_per_km") / 1000, 6), f"{k}_mg_per_km": F.bround(f"{k}_per_km", 6), f"{k}_mg_per_liter": per_litre(k)}
    return out


def register_costs(requests: DataFrame, parts: DataFrame, register_stats: DataFrame, sensor_models: DataFrame, speeds: Column | None = None) -> DataFrame:
    """The cost of each request in each class it asks for, by the register's means over years (from the request's year on),
    moved from the base speed to the request's by the sensors' growth factors. A class needs both kinds of data. With speeds,
    an array, a row for each of them (column speed) instead of the request's own."""
    asked = with_defaults(requests)
    # a statistic counts for every year asked for up to its own, and for no year (-1): met by equality
    known = register_stats.withColumn("model_year", F.explode(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(FIRST_YEAR), F.greatest("year", F.lit(FIRST_YEAR))))))
    means = []
    for m in REGISTER_MEASURES:
        of = F.col("phenomenon") == m
        means += [F.avg(F.when(of, F.col("value"))).alias(m), F.sum(F.when(of, F.col("numb_cars"))).alias(f"n_{m}")]
    models = known.groupBy("category", "fuel_type", "model_year").agg(*means).join(sensor_models, ["category", "fuel_type"])
    chosen = _chosen(asked).drop("coordinates")
    chosen = chosen.withColumn("model_year", F.coalesce(F.greatest("year", F.lit(FIRST_YEAR)), F.lit(-1)))
    rows = chosen.join(models, ["category", "fuel_type", "model_year"], "left").join(unsized(parts), "request_id")
    if speeds is not None:  # after the joins, which thus don't know of speeds
        rows = rows.withColumn("speed", F.explode(speeds)).withColumn("v", F.col("speed").cast("double"))
    rows = growth_factors(rows, F.col("v")).withColumns(_register_rates(F.col("manual")))
    rows = rows.withColumn("c", carried_cost(F.col("parts"), F.col("litre_per_km"), F.col("tank"), F.col("fuel_type"), False))
    figures = {"manual_consumption": F.col("manual").isNotNull(), "cfd_cars": reported_cars([F.col(f"n_{m}") for m in REGISTER_MEASURES[1:]]), "ec_sensors": F.col("numb_sensors"), "ec_measurements": F.col("measurements")}
    figures |= _register_figures(F.col("km"))
    return _finished(rows.withColumns(figures), [*_HEAD, *(["speed"] if speeds is not None else []), *figures])


def car_costs(requests: DataFrame, parts: DataFrame, cars: DataFrame, sensor_models: DataFrame, wiki: DataFrame) -> DataFrame:
    """One row for each request that names register cars (cfd_ids) of its fuel: means over the cars that have a model. A
    car's growth factors are the means over the sensor models of its classes; cars without one are left out."""
    asked = with_defaults(requests).filter(F.size("cfd_ids") > 0).withColumn("hash_id", F.explode(F.array_distinct("cfd_ids")))
    named = asked.select("request_id", "hash_id", "fuel_type", "v", F.try_element_at("tank_sizes", F.lit("individual")).alias("own_tank"), F.try_element_at("fuel_consumptions", F.lit("individual")).alias("manual"))
    rows = named.join(unsized(cars.dropDuplicates(["hash_id"])), ["hash_id", "fuel_type"])
    classes = rows.select("request_id", "hash_id", "fuel_type", "v", F.explode("wiki_hashes").alias("page")).join(wiki.select(F.col("hash_id").alias("page"), "category"), "page")
    classes = classes.select("request_id", "hash_id", "fuel_type", "v", "category").distinct().join(sensor_models, ["category", "fuel_type"])
    factors = growth_factors(classes, F.col("v")).groupBy("request_id", "hash_id").agg(F.avg("g_fuel").alias("g_fuel"), F.avg("g_co2").alias("g_co2"))
    sensors = classes.groupBy("request_id", "category").agg(F.max("numb_sensors").alias("n")).groupBy("request_id").agg(F.sum("n").alias("ec_sensors"))
    code, english, german, tank = next(c for c in CATEGORIES if c[0] == "individual")
    rows = rows.join(unsized(factors), ["request_id", "hash_id"]).withColumns(_register_rates(F.col("manual"))).filter("litre_per_km is not null")
    rows = rows.join(unsized(parts), "request_id").withColumn("c", carried_cost(F.col("parts"), F.col("litre_per_km"), F.coalesce("own_tank", F.lit(tank)).cast("double"), F.col("fuel_type"), False))
    rates = [F.avg(c).alias(c) for c in ("litre_per_km", "co2_per_km", *[f"{k}_per_km" for k in _POLLUTANTS])]
    state = F.struct(F.avg("c.litres").alias("litres"), F.avg("c.ttc").alias("ttc"), F.avg("c.ht").alias("ht"), F.max("c.date").alias("date")).alias("c")
    mean = rows.groupBy("request_id", "fuel_type").agg(*rates, state, F.first("km").alias("km_raw"), F.count("*").alias("cfd_cars"), F.max(F.col("manual").isNotNull()).alias("manual_consumption"))
    names = {"category": F.lit(code), "category_en": F.lit(english), "category_de": F.lit(german)}
    out = mean.join(unsized(sensors), "request_id", "left").withColumns(names).withColumns(_register_figures(F.col("km_raw")) | {"km": F.bround("km_raw", 2)})
    return out.select(*_HEAD, "manual_consumption", "cfd_cars", "ec_sensors", *[c for c in _register_figures(F.col("km_raw"))])


def speed_sweep(requests: DataFrame, parts: DataFrame, register_stats: DataFrame, sensor_models: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """register_costs at each speed from start to end, in one job: requests, models and parts are joined once, and rows are
    repeated for the speeds after that."""
    return register_costs(requests, parts, register_stats, sensor_models, F.sequence(F.lit(start), F.lit(end), F.lit(step)))


def answers(costs: DataFrame) -> DataFrame:
    """One JSON document for each request: its classes by code, all fields in alphabetical order."""
    fields = sorted(c for c in costs.columns if c not in ("request_id", "category"))
    each = costs.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("category", F.struct(*fields).alias("stats")))).alias("rows"))
    return each.select("request_id", F.to_json(F.struct(F.map_from_entries("rows").alias("fuel_stats"))).alias("body"))
