"""Scans of landed files and writes, on small files."""

import datetime
import hashlib
import json

from tankline.operators import spatial
from tankline.sources import readers, sinks
from tankline.streaming import ingest


def lines(path, *rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_countries_and_boundaries(spark, tmp_path):
    (tmp_path / "c.csv").write_text('official_name_en,ISO3166-1-Alpha-2,ISO3166-1-Alpha-3,ISO3166-1-numeric,other\n"Bonaire, Saba",BQ,BES,535,x\nFrance,FR,FRA,250,x\nNone,,XXX,1,x\n')
    codes = readers.country_codes(spark, str(tmp_path / "c.csv"))
    assert [r["name"] for r in codes.orderBy("name").collect()] == ["Bonaire, Saba", "France"]
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    shape = lambda two, three, kind, c: {"properties": {"iso_a2": two, "iso_a3": three}, "geometry": {"type": kind, "coordinates": c}}
    path = lines(tmp_path / "b.json", shape("BQ", None, "Polygon", square), shape("-99", "FRA", "MultiPolygon", [square, square]), shape("FR", "XX", "MultiPolygon", [square]) | {"properties": {"iso_a2": None, "iso_a3": None}})
    shaped = readers.with_boundaries(codes, readers.boundaries(spark, path)).orderBy("name").collect()
    assert [len(r["polygons"]) for r in shaped] == [1, 2]
    edges = spatial.edges(readers.with_boundaries(codes, readers.boundaries(spark, path)).withColumnRenamed("country_alpha_2", "country"))
    assert edges.count() == 12


def test_register_in_windows_encoding(spark, tmp_path):
    text = "Manufacturer,Model,Description,Fuel Type,Metric Combined,Euro Standard,Date of change\nCitroën,C4 – Aircross,x 2012,Diesel,5.1,6,3 March 2014\nVW,Golf,,Petrol,N/A,5,bad\nVW,Polo,,Petrol / Gas,x,,3 March 2014\n"
    (tmp_path / "r.csv").write_bytes(text.encode("windows-1252"))
    rows = readers.register(spark, str(tmp_path / "r.csv"), 2026).collect()
    assert [(r["manufacturer"], r["model"], r["fuel_type"], r["metric_combined"], r["year"], r["euro_standard"]) for r in rows] == [("Citroën", "C4 – Aircross", "diesel", 5.1, 2012, "6"), ("VW", "Golf", "gasoline", None, None, "5"), ("VW", "Polo", "Petrol / Gas", None, 2014, None)]
    assert rows[0]["date_of_change"] == datetime.date(2014, 3, 3) and rows[1]["date_of_change"] is None


def test_price_sheets(spark):
    countries = spark.createDataFrame([("AT", "AUT"), ("GB", "GBR")], "country_alpha_2 string, country_alpha_3 string")
    sheet = spark.createDataFrame([("AUT", "38355", "1", "1", "7.5", ""), ("GB", "38355", "0.7", "0", "x", "2"), ("ZZ", "38355", "1", "1", "1", "1"), ("AT", "note", "1", "1", "1", "1")], "code string, serial string, taux string, euro_price string, euro string, diesel string")
    rows = readers.price_rows(sheet, countries).orderBy("country").collect()
    assert [(r["country"], r["date"], r["euro_super_95"], r["diesel"], r["unit"], r["quantity"]) for r in rows] == [("AT", datetime.date(2005, 1, 3), 7.5, 0.0, "liter", 1000), ("GB", datetime.date(2005, 1, 3), 0.0, 2.0, "liter", 1000)]
    assert readers.general_prices(sheet).count() == 3


def test_sensor_pages(spark, tmp_path):
    for i, kind in enumerate(("car", "FeatureCollection")):
        (tmp_path / f"s{i}.json").write_text(json.dumps({"sensors": [{"type": kind, "properties": {"id": str(i), "manufacturer": "VW", "model": "Golf", "fuelType": "diesel", "constructionYear": 2001}}]}, indent=1))
    assert [r["sensor_id"] for r in readers.sensors(spark, str(tmp_path)).collect()] == ["0"]
    (tmp_path / "p.json").write_text(json.dumps({"phenomenons": [{"name": "Speed", "unit": "km/h"}, {"name": "CO2", "unit": "kg/h"}]}))
    assert readers.phenomena(spark, str(tmp_path / "p.json")).count() == 2
    (tmp_path / "st.json").write_text(json.dumps({"sensor_id": "7", "statistics": [{"max": 3, "avg": 2, "min": 1, "measurements": 9, "tracks": 2, "phenomenon": {"name": "Speed"}}]}))
    r = readers.entity_statistics(spark, str(tmp_path / "st.json"), "sensor_id").first()
    assert (r["sensor_id"], r["phenomenon"], r["max"], r["avg"], r["numb_measurements"], r["numb_users"]) == ("7", "Speed", 3, 2, 9, None)
    (tmp_path / "t.json").write_text(json.dumps({"tracks": [{"id": "a", "length": None, "sensor": {"properties": {"id": "7"}}}]}))
    assert readers.tracks(spark, str(tmp_path / "t.json")).first()["track_length"] == 0
    listing = spark.createDataFrame([("Category:Vans", ["A", "B", "A"]), ("Kategorie:Van", ["C"])], "category string, members array<string>")
    assert {(r["page_language"], r["title"]) for r in readers.category_members(listing).collect()} == {("en", "A"), ("en", "B"), ("de", "C")}


def test_missing_texts_and_scoped_scans(spark):
    wiki = spark.createDataFrame([("a",), ("b",), ("c",)], "hash_id string")
    stored = spark.createDataFrame([("a", "known"), ("b", None)], "hash_id string, page_text string")
    body = json.dumps({"query": {"pages": {"1": {"extract": 'A "car".\nNew é'}}}})
    fetched = spark.createDataFrame([("a", body), ("b", body), ("c", "{}"), ("z", body)], "hash_id string, body string")
    assert [tuple(r) for r in readers.missing_texts(wiki, stored, fetched).collect()] == [("b", 'A "car".\nNew é')]
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "track_id int, v string")
    wanted = spark.createDataFrame([(1,), (2,), (2,)], "track_id int")
    assert readers.of_tracks(rows, wanted).count() == 2 and readers.of_tracks(rows, wanted, 1).first()["v"] == "x"
    assert set(readers.profile({"sensors": rows, "tracks": rows}, "averages")) == {"sensors"}


def test_registry_versions_and_reports(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.csv").write_text("1")
    (tmp_path / "src/b.csv").write_text("2")
    known = spark.createDataFrame([(hashlib.sha1(b"1").hexdigest(),)], "object_hash string")
    changed = sinks.changed_sources(spark, str(tmp_path / "src"), known).collect()
    assert [r["object_name"].rsplit("/", 1)[1] for r in changed] == ["b.csv"]
    path, schema = str(tmp_path / "table"), "k int, v string"
    read = lambda: sinks.read_table(spark, path, schema)
    assert read().count() == 0
    for _ in range(2):
        sinks.upsert_table(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], schema), schema, "k")
    sinks.upsert_table(spark, path, spark.createDataFrame([(2, "c")], schema), schema, "k")
    assert sorted(tuple(r) for r in read().collect()) == [(1, "a"), (2, "c")]
    sinks.write_csv(read(), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    sinks.write_json_documents(spark.createDataFrame([(1, 2)], "b int, a int"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"a":2,"b":1}'
    sinks.truncate(spark, path)
    assert read().count() == 0
    sinks.upsert_table(spark, path, spark.createDataFrame([(None, "x"), (None, "y"), (3, "z")], schema), schema, "k", order="v")
    sinks.upsert_table(spark, path, spark.createDataFrame([(None, "w")], schema), schema, "k")
    assert sorted((tuple(r) for r in read().collect()), key=str) == [(3, "z"), (None, "w")]
    for name in ("sensor", "track", "other"):
        spark.createDataFrame([(1,)], "k int").write.parquet(str(tmp_path / "root" / name))
    assert sinks.truncate_all(spark, str(tmp_path / "root")) == ["track", "sensor"]
    assert [spark.read.parquet(str(tmp_path / "root" / n)).count() for n in ("sensor", "track", "other")] == [0, 0, 1]
    cars = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "hash_id string, wiki_hashes array<string>")
    new = spark.createDataFrame([("b", ["z"])], "hash_id string, wiki_hashes array<string>")
    assert sorted(tuple(r) for r in sinks.updated_matches(cars, new).collect()) == [("a", ["x"]), ("b", ["z"])]


def page(track, *points):
    return {"properties": {"id": track, "sensor": {"properties": {"id": "s"}}}, "features": [{"geometry": {"coordinates": [1.0, 2.0]}, "properties": {"id": i, "time": t, "phenomenons": {"Speed": {"value": v, "unit": "km/h"}, "CO2": {"value": v / 2, "unit": "kg/h"}}}} for i, t, v in points]}


def test_two_incremental_runs_equal_one_batch(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    t = "2024-01-0{}T00:00:00Z"
    (folder / "1.json").write_text(json.dumps(page("t1", ("p1", t.format(1), 10.0), ("p2", t.format(2), 20.0))))
    stats = str(tmp_path / "stats")
    for _ in range(2):
        ingest.append(ingest.measurement_pages(spark, str(folder)), out, mark).awaitTermination()
        ingest.running_statistics(ingest.measurement_pages(spark, str(folder)), stats, str(tmp_path / "mark2")).awaitTermination()
        (folder / "2.json").write_text(json.dumps(page("t2", ("p2", t.format(2), 20.0), ("p3", t.format(3), 60.0))))
    got = spark.read.parquet(out)
    assert got.count() == 6 and got.select("track_measurement_id", "phenomenon").distinct().count() == 6
    pages = spark.read.schema(readers.FEATURES).option("multiLine", True).json(str(folder))
    points, values = readers.track_features(pages)
    assert points.count() == 4
    batch = values.dropDuplicates(["track_measurement_id", "phenomenon"])
    keep = ["track_measurement_id", "phenomenon", "phenomenon_value"]
    assert sorted(map(tuple, got.select(*keep).collect())) == sorted(map(tuple, batch.select(*keep).collect()))
    r = sinks.read_table(spark, stats, ingest.STATE).filter("phenomenon = 'Speed'").first()
    assert (r["max"], r["min"], r["sum"], r["n"]) == (60, 10, 110, 4)


def test_streamed_upsert_and_changed_prices(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k int, v string"
    table = str(tmp_path / "t")
    for v in ("a", "b"):
        lines(tmp_path / f"in/{v}.json", {"k": 1, "v": v})
        ingest.upsert_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), table, schema, ("k",), str(tmp_path / "m")).awaitTermination()
    assert [tuple(r) for r in sinks.read_table(spark, table, schema).collect()] == [(1, "b")]
    p = spark.createDataFrame([("A", 1), ("B", 1)], "country string, date int")
    none = spark.createDataFrame([], "object_hash string")
    assert [r["country"] for r in ingest.changed_prices(spark, str(tmp_path / "in"), none, p, p.filter("country = 'A'")).collect()] == ["B"]
    known = sinks.changed_sources(spark, str(tmp_path / "in"), none).select("object_hash")
    assert ingest.changed_prices(spark, str(tmp_path / "in"), known, p, p.limit(0)).count() == 0


def test_old_tracks_and_repeated_batches_are_stored_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(page("t1", ("p1", "2024-05-01T00:00:00Z", 10.0), ("p1", "2024-05-01T00:00:00Z", 10.0))))
    run = lambda mark: ingest.append(ingest.measurement_pages(spark, str(folder)), out, str(tmp_path / mark)).awaitTermination()
    run("a")
    (folder / "2.json").write_text(json.dumps(page("t2", ("p2", "2020-01-01T00:00:00Z", 20.0), ("p3", None, 5.0))))
    run("a")  # years older than what is stored
    assert spark.read.parquet(out).count() == 6
    run("b")  # all pages once more, as after a lost checkpoint
    assert spark.read.parquet(out).count() == 6


def test_files_of_any_size_are_hashed(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 70_000)
    (tmp_path / "b").write_bytes(b"")
    with open(tmp_path / "large", "wb") as f:  # 3 GB that take no room
        f.truncate(3 << 30)
    told = {r.object_name.rsplit("/", 1)[1]: (r.object_hash, r.bytes) for r in sinks.file_hashes(spark, str(tmp_path)).collect()}
    zeros = hashlib.sha1()
    for _ in range(3 << 6):
        zeros.update(bytes(1 << 24))
    assert told == {"a": (hashlib.sha1(b"x" * 70_000).hexdigest(), 70_000), "large": (zeros.hexdigest(), 3 << 30)}
    again = {r.object_name.rsplit("/", 1)[1]: (r.object_hash, r.bytes) for r in sinks.file_hashes(spark, str(tmp_path), whole=1000).collect()}
    assert again == told
    known = sinks.file_hashes(spark, str(tmp_path)).filter("bytes < 100000").select("object_hash")
    assert [r.object_name.rsplit("/", 1)[1] for r in sinks.changed_sources(spark, str(tmp_path), known).collect()] == ["large"]
