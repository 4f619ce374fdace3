"""Operators on small literal tables, properties, and plans."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tankline.operators import brands, listings, matching, prices, routes, sensors, similarity, spatial, statistics
from tankline.plans import queries
from tankline.sources import adapters, readers, sinks
from tankline.sources.loads import load

SF = "/root/testdata/sf0.001"


def test_weighted_means_and_clamp(spark):
    s = spark.createDataFrame([(1, "car", "a", "petrol"), (2, "car", "A ", "gas"), (3, "car", "b", "x")], "sensor_id long, sensor_type string, manufacturer_raw string, fuel_raw string")
    st = spark.createDataFrame([(1, "Speed", 10.0, 4.0, -3.0, 10), (2, "Speed", 20.0, 8.0, 5.0, 10)], "sensor_id long, phenomenon string, max double, avg double, min double, numb_measurements long")
    r = statistics.vehicle_type_averages(s, st).first()
    assert (r["min"], r["average"], r["max"], r["measurements"], r["numb_sensors"]) == (2.5, 6, 15, 20, 2)
    assert [r["manufacturer"] for r in statistics.manufacturer_averages(s, st, 0).collect()] == ["a"] and statistics.manufacturer_averages(s, st).count() == 0
    zero = st.withColumn("numb_measurements", F.lit(0))
    assert statistics.vehicle_type_averages(s, zero).first()["average"] is None
    assert sensors.match_counts(sensors.with_statistics(s, st)).first().asDict() == {"matched": 2, "missing": 1}


def test_category_needs_three_phenomena(spark):
    cols = "category string, fuel_type string, phenomenon string, max double, average double, min double, measurements double, numb_sensors long"
    rows = [("a", "diesel", p, 100.0, 50.0, 1.0, 5.0, 2) for p in ("Speed", "Consumption", "CO2")] + [("b", "diesel", p, 1.0, 1.0, 1.0, 5.0, 2) for p in ("Speed", "CO2")]
    got = statistics.sensor_fuel_models(spark.createDataFrame(rows, cols)).collect()
    assert [r["category"] for r in got] == ["a"] and got[0]["speed_average"] == 50


def test_weighted_means_lie_between_and_ignore_order(spark):
    stats, known = adapters.sensor_statistics(spark, SF), adapters.sensors(spark, SF)
    rows = statistics.vehicle_type_averages(known, stats).collect()
    assert all(r["min"] <= r["average"] <= r["max"] for r in rows)
    again = statistics.vehicle_type_averages(known.orderBy(F.rand(1)), stats.orderBy(F.rand(2))).collect()
    key = lambda r: (r["fuel_type"], r["phenomenon"])
    assert [r["average"] for r in sorted(rows, key=key)] == pytest.approx([r["average"] for r in sorted(again, key=key)])


def test_blocks_and_histories(spark):
    d = datetime.date
    sheet = spark.createDataFrame([("s", 0, "AT", None, None), ("s", 1, None, d(2005, 1, 3), 1.0), ("s", 2, "BE", None, None), ("s", 3, None, d(2005, 1, 3), 2.0), ("t", 0, None, d(2005, 1, 3), 9.0)], "sheet string, row_idx int, code string, date date, euro double")
    assert sorted((r["country"], r["euro"], r["quantity"]) for r in readers.block_prices(sheet).collect()) == [("AT", 1.0, 1000), ("BE", 2.0, 1000)]
    side = lambda rows: spark.createDataFrame(rows, "date date, euro_super_95 double, diesel double")
    merged = prices.merged_tax_sides(side([(d(2001, 1, 1), 3.0, 2.0)]), side([(d(2001, 1, 1), 1.5, 1.0), (d(2001, 1, 8), 1.6, 1.1)]), "date").orderBy("date").collect()
    assert [(r["euro_ttc"], r["euro_ht"]) for r in merged] == [(3.0, 1.5), (None, 1.6)]
    assert spark.range(1).select(prices.excel_date(F.lit(38355)), prices.excel_date(F.lit(0), 1)).first()[:] == (d(2005, 1, 3), d(1904, 1, 1))
    p = spark.createDataFrame([("A", d(2001, 1, 1), 1000.0, 1.0, 1.0, 1.0, 1000), ("A", d(2002, 1, 1), 2000.0, 1.0, None, 1.0, 1000)], "country string, date date, euro_ttc double, euro_ht double, diesel_ttc double, diesel_ht double, quantity int")
    assert prices.latest(p, "country").first()["euro_ttc"] == 2 and prices.latest(p).count() == 1 and prices.latest(p.limit(0)).count() == 0


def test_brand_names(spark):
    aliases = brands.alias_table(spark)
    listed = spark.createDataFrame([("Porsche",), ("Trabant",), ("VW",)], "brand string")
    asked = spark.createDataFrame([("vw ",), ("VOLKSWAGEN",), ("trabant",), ("",), (None,), ("nobody",), ("motors",)], "raw string")
    got = {r["raw"]: r["brand"] for r in brands.normalized(asked, "raw", aliases, listed).collect()}
    assert got == {"vw ": "VW", "VOLKSWAGEN": "VW", "trabant": "Trabant", "": "", None: "", "nobody": "", "motors": ""}
    loose = {r["raw"]: r["brand"] for r in brands.normalized_loosely(asked, "raw", aliases, listed).collect()}
    assert loose == got | {"motors": "Vauxhall"}


def test_titles(spark):
    aliases = brands.alias_table(spark, {"VW": ["vw"], "Porsche": [" VW-Porsche"]})
    listed = spark.createDataFrame([("Audi",), ("VW",)], "brand string")
    vehicles = spark.createDataFrame([("DS 4S", "Citroën", "DS 4S")], "raw string, brand string, name string")
    ignored = spark.createDataFrame([("VW Museum",)], "title string")
    titles = ["VW-Porsche 914", "VW Golf IV", "VW Golf IV", "Audi -80", "Audio 5", "DS 4S", "VW Museum", "VW (Marke)", "VW", "", None]
    got = {(r["title"], r["brand"], r["model"]) for r in brands.title_to_car(spark.createDataFrame([(t,) for t in titles], "title string"), aliases, listed, vehicles, ignored).collect()}
    assert got == {("VW-Porsche 914", "Porsche", "914"), ("VW Golf IV", "VW", "Golf IV"), ("Audi -80", "Audi", "80"), ("DS 4S", "Citroën", "DS 4S")}


def test_vehicle_dictionary(spark):
    words = spark.createDataFrame([("grund cherokee", "Jeep", "Grand Cherokee"), ("fiat punto", "Fiat", "Punto II")], "raw string, brand string, name string")
    s = spark.createDataFrame([("x", "Grund Cherokee"), ("Fiat", "Punto"), ("a", "b")], "manufacturer string, model string")
    assert sorted(tuple(r) for r in sensors.rewritten(s, words).collect()) == [("Fiat", "Punto II"), ("Jeep", "Grand Cherokee"), ("a", "b")]


def squares(spark, *boxes):
    rings = [[[[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]]] for x, y, w in boxes]
    return spark.createDataFrame([(f"N{i}", r) for i, r in enumerate(rings)], "country string, polygons array<array<array<struct<x:double,y:double>>>>")


def line(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "request_id int, coordinates array<struct<x:double,y:double>>")


def test_overlay_of_known_lines(spark):
    lands = squares(spark, (0.0, 0.0, 2.0), (2.0, 0.0, 2.0), (1.0, 5.0, 1.0))
    lines = line(spark, [(0.5, 1.0), (3.5, 1.0)], [(-1.0, 0.5), (5.0, 0.5), (5.0, 5.5), (0.0, 5.5)], [(9.0, 9.0), (10.0, 9.0)], [(1.0, 1.0)])
    got = {}
    for r in spatial.overlay(lines, lands, 0.7).collect():
        got[r["request_id"], r["country"]] = got.get((r["request_id"], r["country"]), 0) + ((r["x1"] - r["x0"]) ** 2 + (r["y1"] - r["y0"]) ** 2) ** 0.5
    assert got == pytest.approx({(0, "N0"): 1.5, (0, "N1"): 1.5, (1, "N0"): 2, (1, "N1"): 2, (1, "N2"): 1, (1, None): 11, (2, None): 1})


def test_overlay_parts_add_up_over_a_polygon_with_a_hole(spark):
    outer, hole = [(0.0, 0.0), (9.0, 1.0), (8.0, 9.0), (1.0, 8.0), (0.0, 0.0)], [(3.0, 3.0), (6.0, 3.0), (5.0, 6.0), (3.0, 3.0)]
    land = spark.createDataFrame([("A", [[outer, hole]])], "country string, polygons array<array<array<struct<x:double,y:double>>>>")
    draw = random.Random(4)
    lines = [[(draw.uniform(-2, 11), draw.uniform(-2, 11)) for _ in range(6)] for _ in range(20)]
    pieces = spatial.overlay(line(spark, *lines), land).collect()

    def inside(x, y):
        odd = False
        for ring in (outer, hole):
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                odd ^= (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
        return odd

    assert all(inside((r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2) == (r["country"] == "A") for r in pieces)
    for i, pts in enumerate(lines):
        whole = sum(((a - c) ** 2 + (b - d) ** 2) ** 0.5 for (a, b), (c, d) in zip(pts, pts[1:]))
        assert sum(((r["x1"] - r["x0"]) ** 2 + (r["y1"] - r["y0"]) ** 2) ** 0.5 for r in pieces if r["request_id"] == i) == pytest.approx(whole, rel=1e-9)


def test_points_in_countries(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.5, 1.5), (3, 7.0, 7.0)], "point_id int, x double, y double")
    got = spatial.point_countries(points, squares(spark, (0.0, 0.0, 2.0), (2.0, 0.0, 2.0))).collect()
    assert {(r["point_id"], r["country"]) for r in got} == {(1, "N0"), (2, "N1")}


@pytest.mark.parametrize("cell", [0.7, 1.0, 3.0])
def test_points_of_a_ragged_country_with_a_hole(spark, cell):
    draw = random.Random(11)
    star = [(5 + draw.uniform(2, 6) * math.cos(i * math.tau / 40), 5 + draw.uniform(2, 6) * math.sin(i * math.tau / 40)) for i in range(40)]
    rings = [[*star, star[0]], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]]
    land = spark.createDataFrame([("A", [rings]), ("B", [[[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0), (0.0, 0.0)]]])], "country string, polygons array<array<array<struct<x:double,y:double>>>>")
    points = [(i, draw.uniform(-2, 12), draw.uniform(-2, 12)) for i in range(1500)]
    odd = lambda x, y: sum((ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay) for r in rings for (ax, ay), (bx, by) in zip(r, r[1:])) % 2
    want = {(i, "A") for i, x, y in points if odd(x, y)} | {(i, "B") for i, x, y in points if 0 < x < 3 and 0 < y < 3}
    got = spatial.point_countries(spark.createDataFrame(points, "point_id int, x double, y double"), land, cell).collect()
    assert {(r.point_id, r.country) for r in got} == want and len(got) == len(want)


def fold(spark, parts, tank, whole):
    rows = [(0, i, None, km, None, p, p / 2, p, p) for i, (km, p) in enumerate(parts)]
    df = spark.createDataFrame([(rows,)], "parts array<struct<last:int,newest:int,country:string,km:double,date:date,euro_ttc:double,euro_ht:double,diesel_ttc:double,diesel_ht:double>>")
    return df.select(routes.carried_cost(F.col("parts"), F.lit(1.0), F.lit(float(tank)), F.lit("gasoline"), whole).alias("c")).first()["c"]


def by_hand(parts, tank, whole):
    left, before, cost = 0.0, None, 0.0
    for litres, price in parts:
        before = price if before is None else before
        if left > 0:
            cost += before * left
            before = price
        need = litres - left if left > 0 else litres
        left = max(0.0, tank * -(-need // tank) - need if whole else tank * round(need / tank, 5) - litres)
        cost += price * need
    return cost


def test_tank_is_carried_over(spark):
    assert fold(spark, [(30.0, 1.0), (40.0, 2.0)], 50, True)["ttc"] == pytest.approx(90)
    draw = random.Random(6)
    for whole in (True, False):
        for _ in range(5):
            parts = [(round(draw.uniform(1, 90), 3), round(draw.uniform(1, 2), 2)) for _ in range(6)]
            got = fold(spark, parts, 45, whole)
            assert got["ttc"] == pytest.approx(by_hand(parts, 45, whole)) and got["litres"] == pytest.approx(sum(p[0] for p in parts)) and got["ht"] == pytest.approx(got["ttc"] / 2)


def test_requests_defaults_and_individual_costs(spark):
    r = routes.with_defaults(spark.createDataFrame([(1, None, "fast"), (2, 55, "fast"), (3, None, None)], "request_id int, driving_speed int, driving_style string")).orderBy("request_id").collect()
    assert [x["v"] for x in r] == [90, 55, 70] and r[0]["fuel_type"] == "gasoline" and r[0]["vehicle_categories"] == ["all"]
    rows = queries.route_cost_cars(spark, SF).collect()
    assert rows and all(x["category"] == "individual" and x["cfd_cars"] >= 1 and x["km"] > 0 for x in rows)
    answer = json.loads(queries.route_answers(spark, SF).first()["body"])
    assert len(answer["fuel_stats"]) == 11 and list(answer["fuel_stats"]["a"]) == sorted(answer["fuel_stats"]["a"])


def test_tank_sizes_consumption_and_year_of_a_request(spark):
    parts = queries._parts(spark, SF)
    base = adapters.routes(spark, SF).filter("request_id = 20")
    asked = base.withColumns({"vehicle_categories": F.array(F.lit("a")), "tank_sizes": F.create_map(F.lit("a"), F.lit(30)), "fuel_consumptions": F.create_map(F.lit("a"), F.lit(5.0)), "year": F.lit(1998)})
    stats, models = queries._register_stats(spark, SF), queries._sensor_models(spark, SF)
    r = routes.register_costs(asked, parts, stats, models).collect()
    plain = routes.register_costs(base, parts, stats, models).filter("category = 'a'").first()
    assert len(r) == 1 and r[0]["manual_consumption"] and not plain["manual_consumption"] and r[0]["cfd_cars"] < plain["cfd_cars"]


def test_similarity_ratios(spark):
    assert similarity.ratio("abc", "abc") == 100 and similarity.ratio("abcd", "abxd") == 75 and similarity.ratio("", "") == 100 and similarity.ratio("a", "") == 0
    assert similarity.token_sort_ratio("golf vw", "VW Golf") == 100 and similarity.token_set_ratio("vw golf", "vw golf variant") == 100
    rows = spark.createDataFrame([("VW Golf 2012", "Golf VW", 2012), ("Audi A4", "Audi A8", None), ("Golf", "Golf", None), ("VW Golf (IV)", "VW-Golf", None), (None, "VW Golf", None)], "a string, b string, y int")
    assert [r[0] for r in similarity.with_similarity(rows.withColumn("i", F.monotonically_increasing_id()), similarity.judgement(F.col("a"), F.col("b"), F.col("y"))).orderBy("i").select("alike").collect()] == [True, False, False, True, False]


def test_ratio_equals_the_plain_table():
    draw = random.Random(8)
    for _ in range(200):
        a, b = ("".join(draw.choices("abc ", k=draw.randrange(1, 12))) for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert similarity.ratio(a, b) == pytest.approx(200 * row[-1][-1] / (len(a) + len(b)))


def test_matching_rules(spark):
    wiki = spark.createDataFrame([("h1", "VW Golf", "VW", "Golf"), ("h2", "Audi A4", "Audi", "A4"), ("h3", "BMW X", "BMW", "X")], "hash_id string, wiki_name string, brand_name string, car_name string")
    scored = [(1, "VW", "Golf Plus", None, "VW Golf", 0.999), (2, "VW", "Golf Plus", None, "VW Golf", 0.95), (3, "VW", "Golf VW Golf", None, "VW Golf", 0.3), (4, "Audi", "Q", None, "Audi A4", 0.86), (5, "BMW", "Y", None, "BMW X", 0.95), (6, "VW", "Polo", None, "VW Golf", 0.5)]
    df = spark.createDataFrame(scored, "car_id int, brand string, name string, year int, tag string, score double")
    got = {r["car_id"]: r["rule"] for r in matching.accepted(df, wiki, brands.alias_table(spark), 0.96).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["car_id"] for r in matching.accepted(df, wiki, brands.alias_table(spark), 0.96, False).collect()} == {1}
    cars = spark.createDataFrame([(1, "VW", "golf", 2001, "TDI"), (2, "VW", "Golf Plus TDI", 2001, ""), (3, "Audi", "s1", 1990, "x"), (4, "VW", "Polo", 1, "")], "car_id int, brand string, name string, year int, description string")
    curated = spark.createDataFrame([("Audi", "s11990", "Audi A4")], "brand string, entry string, wiki_name string")
    assert {(r["car_id"], r["stage"], r["hash_id"]) for r in matching.match_register(cars, wiki, curated).collect()} == {(1, 1, "h1"), (2, 6, "h1"), (3, 0, "h2")}
    found = matching.match_sensors(cars, wiki, curated)
    assert {(r["car_id"], r["stage"]) for r in found.collect()} == {(1, 1), (3, 0)}
    assert matching.bridge(found).select("object_hash").distinct().count() == 2
    queue = matching.review_queue(cars, found)
    assert matching.accuracy(queue).first()[0] == 0.5
    verdict = spark.createDataFrame([("VW", "VW Polo", "VW Golf", False)], "brand string, name string, tag string, right boolean")
    new = matching.verdict_patterns(verdict)
    assert {(r["polarity"], r["pattern"]) for r in new.collect()} == {("negative", "Polo"), ("negative", "polo"), ("negative", "POLO")}
    assert matching.merged_patterns(new, new).count() == 3


def test_sensor_stages_are_united(spark):
    pages = [("h1", "VW Golf", "VW", "Golf"), ("h2", "VW Golf (IV)", "VW", "Golf 2001"), ("h3", "VW Polo 2002", "VW", "x"), ("h4", "VW Golf", "VW", "y")]
    wiki = spark.createDataFrame(pages, "hash_id string, wiki_name string, brand_name string, car_name string")
    cars = spark.createDataFrame([(1, "VW", "golf", 2001), (2, "VW", "Polo", 2002), (3, "VW", "Golf", None)], "car_id int, brand string, name string, year int")
    found = matching.match_sensors(cars, wiki, spark.createDataFrame([], "brand string, entry string, wiki_name string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "h1"), (1, 2, "h2"), (1, 3, "h4"), (2, 4, "h3"), (3, 1, "h1"), (3, 3, "h4")]


def test_name_matches_are_all_pairs_that_share_a_word(spark):
    draw, vocabulary = random.Random(5), "red rod large small box".split()
    name = lambda: " ".join(draw.choices(vocabulary, k=draw.randrange(1, 4)))
    cars = [(i, draw.choice("AB"), name()) for i in range(40)] + [(40, "A", "red rod large"), (41, "B", None), (42, None, "red")]
    pages = [(b, f"{b} {n}", n) for b, n in ((draw.choice("AB"), name()) for _ in range(30))] + [("A", "A large box", "large box"), ("A", "A red rod", "red rod"), ("B", "B none", None)]
    want = set()
    for i, brand, n in cars:
        for b, tag, c in pages:
            x, y = set((n or "").split()), set((c or "").split())
            if brand == b and x & y:
                want.add((i, tag, 2 * len(x & y) / (len(x) + len(y))))
    got = matching.name_matches(spark.createDataFrame(cars, "car_id int, brand string, name string"), spark.createDataFrame(pages, "brand_name string, wiki_name string, car_name string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and {(40, "A large box", 0.4), (40, "A red rod", 0.8)} <= want


def test_classifier_learns_and_scores(spark):
    wiki = spark.createDataFrame([("VW", "VW Golf", "Golf"), ("VW", "VW Polo", "Polo"), ("Audi", "Audi A4", "A4")], "brand_name string, wiki_name string, car_name string")
    labelled = spark.createDataFrame([("VW", "VW Golf", "positive", "rabbit"), ("VW", "VW Golf", "negative", "GOLF")], "brand string, tag string, polarity string, pattern string")
    pages = spark.createDataFrame([("VW", "VW Golf", "The Golf is a car. It rains.")], "brand string, tag string, page_text string")
    patterns = matching.training_patterns(wiki, labelled, pages)
    by = {r["pattern"] for r in patterns.filter("tag = 'VW Golf'").collect()}
    assert {"rabbit", "the golf is a car"} <= by and "GOLF" not in by and "it rains" not in by
    model = matching.train(patterns)
    cars = spark.createDataFrame([(1, "VW", "Golf Plus"), (2, "Audi", "A4")], "car_id int, brand string, name string")
    texts = matching.candidate_texts(cars, spark.createDataFrame([("VW", "Volkswagen")], "brand string, alias string"))
    assert texts.filter("car_id = 1").count() == 2 * 9 and texts.filter("text = 'Volkswagen Golf Plus'").count() == 1
    best = matching.scores(model, texts, keep=1).groupBy("car_id").agg(F.max_by("tag", "score").alias("tag")).collect()
    assert {r["car_id"]: r["tag"] for r in best} == {1: "VW Golf", 2: "Audi A4"}
    assert not matching.needs_training(patterns, 3) and matching.needs_training(patterns, 2)


def test_scores_are_those_of_each_brand(spark):
    patterns = [("A", "A red rod", "red rod"), ("A", "A red rod", "Red"), ("A", "A big rod", "big rod"), ("A", "A van", "van"), ("B", "B red rod", "red rod"), ("B", "B box", "box")]
    asked = [("A", "red rod"), ("A", "big red x"), ("A", "A rod"), ("A", "x"), ("B", "red rod"), ("B", "x"), ("C", "red"), ("A", None)]
    want = {}
    for i, (brand, text) in enumerate(asked):
        own = [(t, set(p.lower().split())) for b, t, p in patterns if b == brand]
        known = set().union(*[w for _, w in own])
        found, raw = set((text or "").lower().split()) & known, {}
        for tag in {t for t, _ in own}:
            bags = [w for t, w in own if t == tag]
            raw[tag] = len(bags) / len(own)
            for w in known:
                p = (sum(w in bag for bag in bags) + matching.SMOOTHING) / (len(bags) + 2 * matching.SMOOTHING)
                raw[tag] *= p if w in found else 1 - p
        want |= {(i, tag): x / sum(raw.values()) for tag, x in raw.items() if x / sum(raw.values()) > 0.25}
    model = matching.train(spark.createDataFrame(patterns, "brand string, tag string, pattern string"))
    texts = spark.createDataFrame([(i, *x) for i, x in enumerate(asked) if x[1]], "car_id int, brand string, text string")
    got = {(r["car_id"], r["tag"]): r["score"] for r in matching.scores(model, texts).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if k[0] != 7})


def test_listings(spark):
    rows = [("h1", "VW", "Golf, 2012", "TDI", "diesel", 2012, ["p"]), ("h2", "VW", "golf", "TDI", "diesel", 2012, ["p"]), ("h3", "VW", "Golf", "x", "hay", 2012, ["p"]), ("h4", "VW", "Golf", "x", "diesel", 2013, [])]
    cars = spark.createDataFrame(rows, "hash_id string, manufacturer string, model string, description string, fuel_type string, year int, wiki_hashes array<string>")
    ids = listings.car_ids(cars)
    assert {(r["level"], r["year"], r["description"], tuple(r["ids"])) for r in ids.collect()} == {("all", None, None, ("h1", "h2")), ("year", 2012, None, ("h1", "h2")), ("description", 2012, "TDI", ("h1", "h2"))}
    nested = listings.nested_car_ids(ids).first()
    assert nested["all_ids"] == ["h1", "h2"] and nested["by_year"] == {"2012": ["h1", "h2"]}
    assert listings.match_counts(cars).first().asDict() == {"matched": 3, "unmatched": 1, "unique_matches": 1}
    assert [r["brand"] for r in listings.brands(spark.createDataFrame([("b ",), ("",), (None,)], "brand string"), spark.createDataFrame([("a",), ("b",)], "brand string")).collect()] == ["a", "b"]
    assert [x["hash_id"] for x in listings.grouped(cars, "manufacturer", sort=["hash_id"]).first()["rows"]] == ["h1", "h2", "h3", "h4"]


def test_loads_have_keys(spark):
    st = spark.createDataFrame([(1, "Speed", 2.0, 1.0, -1.0, 3)], "sensor_id long, phenomenon string, max double, avg double, min double, numb_measurements long")
    r = load("sensor_statistic", st).first()
    assert r["min"] == 0 and r["avg"] == 1 and len(r["hash_id"]) == 32
    assert load("track", spark.createDataFrame([(1, 2, None)], "track_id int, sensor_id int, track_length double")).first()["track_length"] == 0


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    once = sinks.upserted(old, new, "k", order="n").drop("n")
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(tuple(r) for r in sinks.upserted(once, new, "k", order="n").drop("n").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r["k"] for r in sinks.inserted(old, new, "k").collect()] == [3]


@pytest.mark.parametrize("name", ["route_parts", "route_cost_register", "avg_category_register", "match_register", "title_to_brand"])
def test_plans_have_no_product(spark, name):
    plan = queries.__dict__[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 1  # the one row of the price for all


def test_filters_reach_the_scan(spark):
    plan = A_filter(spark)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in plan and "o_orderpriority" not in plan


def A_filter(spark):
    return readers.stored(spark, f"{SF}/orders.parquet", o_orderkey=5).select("o_orderkey", "o_totalprice")


def test_small_name_operators(spark):
    from tankline.operators import names

    cars = spark.createDataFrame([(1, "VW", "Golf ", 2001, "x"), (2, "VW", "golf", 2001, "y"), (3, "VW", "Golf", None, "x"), (4, "VW", "Golf", None, "X")], "car_id int, brand string, name string, year int, description string")
    assert sorted(r["car_id"] for r in names.unique_cars(cars).collect()) == [1, 3, 4]
    listed = spark.createDataFrame([("GOLF",), ("polo",)], "word string")
    assert names.in_word_list(cars, "description", listed).count() == 0 and names.in_word_list(cars, "name", listed).count() == 4
    assert sorted(r["car_id"] for r in names.top_per_group(cars, "brand", [F.desc("car_id")], 2).collect()) == [3, 4]


def test_point_prices(spark):
    from tankline.operators import names

    p = spark.createDataFrame([("N0", datetime.date(2001, 1, 1), 2000.0, 1000.0, 3000.0, 1.0, 1000)], "country string, date date, euro_ttc double, euro_ht double, diesel_ttc double, diesel_ht double, quantity int")
    points = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 1.5, 0.5), (1, 2, 9.0, 0.5)], "route int, seq int, x double, y double")
    general = prices.mean_over_countries(p.withColumn("euro_ttc", F.lit(5000.0)))
    rows = names.point_prices(points, squares(spark, (0.0, 0.0, 2.0)), p, general, 0.1, "gasoline").orderBy("seq").collect()
    assert [(r["country"], r["price"]) for r in rows] == [("N0", 2.0), ("N0", 2.0), (None, 5.0)]
    assert rows[0]["cost"] == 0 and rows[1]["cost"] == pytest.approx(rows[1]["meters"] / 1000 * 0.2)


def test_request_errors(spark):
    body = {"request": "route", "geometry": {"geojson": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "filters": {"data_source": "cfd", "fuel_type": "diesel", "tank_sizes": {"a": 30}}}}
    bad = [(body, None), ("{", 4000), ("", 4000), ({"request": "list"}, 4000), ({"request": "route"}, 4002), ({"request": "route", "geometry": {}}, 4001)]
    point = json.loads(json.dumps(body))
    point["geometry"]["geojson"] = {"type": "LineString", "coordinates": [[1, 2]]}
    bad.append((point, 4007))
    rows = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, (b, _) in enumerate(bad)], "request_id int, body string")
    got = routes.parsed(rows).orderBy("request_id").collect()
    assert [r["error_code"] for r in got] == [c for _, c in bad] and got[0]["tank_sizes"] == {"a": 30}


def test_ratios_are_rounded_and_years_taken_out(spark):
    a, b = "a" * 23 + " x" + "b" * 27, "a" * 23 + " x" + "c" * 5 + "b" * 22
    assert 90 < similarity.ratio(a, b) < 90.5  # 90.4 is 90, which is not over 90
    rows = spark.createDataFrame([(a, b), ("VW Golf 2012 Variant", "VW Golf Variant"), ("VW Golf 1979 Variant", "VW Polo Variant")], "a string, b string")
    assert [r[0] for r in similarity.with_similarity(rows.withColumn("i", F.monotonically_increasing_id()), similarity.judgement(F.col("a"), F.col("b"))).orderBy("i").select("alike").collect()] == [False, True, False]


def test_classifier_steps_of_register_and_sensors(spark):
    wiki = spark.createDataFrame([("h1", "VW", "Golf", "VW Golf", "c"), ("h2", "VW", "Polo", "VW Polo", "b"), ("h3", "VW", "Golf Plus", "VW Golf Plus", "m")], "hash_id string, brand_name string, car_name string, wiki_name string, category string")
    none = spark.createDataFrame([], "brand string, tag string, polarity string, pattern string")
    model = matching.Classifier(*(sinks.kept(t, "model") for t in matching.train(matching.training_patterns(wiki, none))))
    curated = spark.createDataFrame([("VW", "käfer", "VW Golf")], "brand string, entry string, wiki_name string")
    aliases = spark.createDataFrame([("VW", "Volkswagen", 1)], "brand string, alias string, priority int")
    cars = spark.createDataFrame([("a", "VW", "polo", 2001, "x"), ("b", "VW", "golf tsi", 2002, "plus"), ("c", "VW", "Käfer", 1970, "x"), ("d", "VW", "up", 2012, "x"), ("e", "VW", "polo zz qq", 2003, "y")], "car_id string, brand string, name string, year int, description string")
    found = {(r.car_id, r.stage, r.hash_id) for r in matching.match_register_scored(cars, wiki, curated, lambda t: matching.scores(model, t), aliases, required=0.9).collect()}
    assert ("a", 1, "h2") in found and ("c", 0, "h1") in found and ("e", 1, "h2") in found and not [f for f in found if f[0] == "d"]
    assert ("b", 1, "h3") not in found
    found = {(r.car_id, r.stage, r.hash_id) for r in matching.match_sensors_scored(cars.drop("description"), wiki, curated, lambda t: matching.scores(model, t), aliases, required=0.95).collect()}
    assert ("a", 1, "h2") in found and ("c", 0, "h1") in found and not [f for f in found if f[0] == "d"]


def test_contained_names_are_the_choices_of_a_name(spark):
    draw = random.Random(11)
    words = ["golf", "Plus", "TDI", "gti", "golf", "x", "4", "É", "sport"]
    name = lambda n: " ".join(draw.choices(words, k=n))
    cars = [(i, draw.choice("AB"), name(draw.randrange(0, 8))) for i in range(60)] + [(90, "A", "golf 2011 plus 1999"), (91, "A", None), (92, None, "golf")]
    pages = list({(f"{b} {n}", b, n) for b, n in ((draw.choice("AB"), name(draw.randrange(1, 5))) for _ in range(80))})
    cars_df, wiki = spark.createDataFrame(cars, "car_id int, brand string, name string"), spark.createDataFrame(pages, "wiki_name string, brand_name string, car_name string").withColumn("hash_id", F.lit("h"))
    got = {(r.car_id, r.tag) for r in matching.contained_pages(cars_df, wiki).collect()}
    asked = matching.candidate_texts(cars_df.filter("brand is not null"), brands.alias_table(spark).limit(0))
    listed = {(r.car_id, r.text.lower()) for r in asked.collect()}
    by_list = {(c, f"{b} {n}") for c, brand, _ in cars for _, b, n in pages if brand == b and (c, f"{b} {n}".lower()) in listed}
    assert got == by_list and len(got) > 100
    long_name = " ".join(f"w{i}" for i in range(30))
    many = spark.createDataFrame([(1, "A", long_name)], "car_id int, brand string, name string")
    ends = spark.createDataFrame([("p1", "A", "w0 w29"), ("p2", "A", "W29 w0"), ("p3", "A", long_name), ("p4", "A", f"{long_name} w30"), ("p5", "A", "w3 w7 w7"), ("p6", "B", "w0")], "wiki_name string, brand_name string, car_name string")
    assert sorted(r.tag for r in matching.contained_pages(many, ends).collect()) == ["p1", "p3"]


def test_judged_patterns_are_those_that_verdicts_list(spark):
    verdicts = spark.createDataFrame([("VW", "VW Golf Plus TDI", "VW Golf", True), ("VW", "Polo Cross", "VW Polo", False)], "brand string, name string, tag string, right boolean")
    patterns = [("VW", "VW Golf", p) for p in ("golf", "plus tdi", "TDI Plus", "vw golf", "Golf TDI", "x")] + [("VW", "VW Polo", p) for p in ("polo", "golf", "cross")]
    df = spark.createDataFrame(patterns, "brand string, tag string, pattern string")
    listed = {(r.tag, r.polarity, r.pattern.lower()) for r in matching.verdict_patterns(verdicts).collect()}
    got = {(r.tag, r.polarity, r.pattern.lower()) for r in matching.judged_patterns(df, verdicts).collect()}
    assert got == {x for x in listed if x[2] in {p.lower() for _, _, p in patterns}} and len(got) == 5


def ragged(n, x, y, r, draw):
    """A closed ring of n edges around a place."""
    ring = [(x + r * (0.6 + 0.4 * draw.random()) * math.cos(2 * math.pi * i / n), y + r * (0.6 + 0.4 * draw.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*ring, ring[0]]


@pytest.mark.parametrize("edges,rows", [(8, 40), (64, 1), (2, 1000)])
def test_split_and_salted_cells_give_the_same_parts(spark, monkeypatch, edges, rows):
    draw = random.Random(6)
    polygons = [("A", [[ragged(300, 0.2, 0.1, 1.7, draw), ragged(60, 0.3, 0.2, 0.4, draw)]]), ("B", [[ragged(40, 2.0, -0.5, 1.2, draw)]]), ("C", [[[(-3.0, -3.0), (4.0, -3.0), (4.0, 4.0), (-3.0, 4.0), (-3.0, -3.0)]]])]
    countries = spark.createDataFrame(polygons, "country string, polygons array<array<array<struct<x:double,y:double>>>>")
    lines = [(i, [(draw.uniform(0.0, 0.9), draw.uniform(0.0, 0.9)) for _ in range(3)]) for i in range(200)] + [(500 + i, [(draw.uniform(-4, 5), draw.uniform(-4, 5)) for _ in range(3)]) for i in range(60)]
    routes = spark.createDataFrame(lines, "request_id int, coordinates array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, draw.uniform(-4, 5), draw.uniform(-4, 5)) for i in range(400)] + [(900, 1.0, 1.0), (901, -1.0, 0.0)], "point_id int, x double, y double")

    def told():
        parts = {}
        for r in spatial.overlay(routes, countries).collect():
            key = (r.request_id, r.seg, r.country)
            parts[key] = parts.get(key, 0) + math.hypot(r.x1 - r.x0, r.y1 - r.y0)
        return parts, sorted((r.point_id, r.country) for r in spatial.point_countries(points, countries).collect())

    whole = told()
    monkeypatch.setattr(spatial, "CELL_EDGES", edges)
    monkeypatch.setattr(spatial, "CELL_ROWS", rows)
    cells, busy = spatial.adapted(spatial.country_cells(countries), points.select(F.floor("x").cast("int").alias("cx"), F.floor("y").cast("int").alias("cy")))
    assert busy.count() and (edges > 8 or cells.agg(F.max("level")).first()[0] > 1) and (rows > 1 or cells.agg(F.max("salt")).first()[0] > 1)
    parts, places = told()
    assert places == whole[1] and parts.keys() == whole[0].keys() and all(parts[k] == pytest.approx(v, abs=1e-9) for k, v in whole[0].items())


def test_half_of_all_segments_in_one_cell_are_dealt_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_ROWS", 100)
    square = spark.createDataFrame([("A", [[[(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0), (0.0, 0.0)]]])], "country string, polygons array<array<array<struct<x:double,y:double>>>>")
    points = spark.range(4000).select(F.col("id").alias("point_id"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(F.col("id") % 7 + 0.5).alias("x"), F.lit(1.5).alias("y"))
    cells, busy = spatial.adapted(spatial.country_cells(square), points.select(F.floor("x").cast("int").alias("cx"), F.floor("y").cast("int").alias("cy")))
    assert cells.filter("cx = 1 and cy = 1").count() >= 20 and spatial.point_countries(points, square).count() == points.filter("x < 5").count()
