"""Scalar functions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from tankline.functions import geodesy, maths, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("Petrol", "gasoline"), (" Diesel ", "diesel"), ("Electricity / Petrol", "gasoline_electric"), ("ELECTRICITY", "electric"), ("steam ", "steam "), (None, None), ("", "")])
def test_fuel_type(spark, raw, want):
    assert one(spark, text.fuel_type(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("name", "as_of", "want"), [("Golf 2011 MY2012", 2026, 2012), ("Golf", 2026, None), ("x 2030 1999", 2026, 1999), ("1979", 2026, None), (None, 2026, None)])
def test_year_in_name(spark, name, as_of, want):
    assert one(spark, text.year_in_name(F.lit(name).cast("string"), as_of)) == want


@pytest.mark.parametrize(("raw", "want"), [("1.23", 1.23), ("1,23", 1.23), ("1.234.567,8", 1234567.8), ("1,234.5", 1.2345), ("x", None), ("", None), (None, None), ("7", 7.0)])
def test_locale_number(spark, raw, want):
    assert one(spark, text.locale_number(F.lit(raw).cast("string"))) == want


def test_names(spark):
    assert one(spark, text.without_repeats(F.lit("VW vw  Golf golf IV"))) == "vw golf iv"
    assert one(spark, text.before_single_comma(F.lit("A4, Avant"))) == "A4" and one(spark, text.before_single_comma(F.lit("a, b, c"))) == "a, b, c"
    assert one(spark, text.without_brackets(F.lit("A-3 (8P) [x]"))) == "A 3"
    assert one(spark, text.punctuation_to_blank(F.lit("a-b/c(d)"))) == "a b c d "
    assert one(spark, text.capitalized(F.lit("gOLF iv"))) == "Golf iv"


@pytest.mark.parametrize(("model", "year", "want"), [("Golf, 2012, TDI", 2012, "Golf  TDI"), ("Golf, MY12", 2012, "Golf"), ("Golf, my", 2012, "Golf"), ("GolfMY2012", 2012, "Golf"), ("Golf MY12", 2012, "Golf"), ("2012, MY12", 2012, "2012, MY12"), ("Golf", None, "Golf")])
def test_clean_model(spark, model, year, want):
    assert one(spark, text.clean_model(F.lit(model), F.lit(year).cast("int"))) == want


def test_powerset(spark):
    assert one(spark, text.powerset(F.array(F.lit("golf"), F.lit("iv")))) == sorted({"golf", "iv", "golf iv", "Golf", "Iv", "Golf Iv", "GOLF", "IV", "GOLF IV"})
    assert one(spark, text.powerset(F.array().cast("array<string>"))) == []
    assert len(one(spark, text.subsets(F.array(*[F.lit(str(i)) for i in range(12)])))) == 4095 and one(spark, text.subsets(F.array(*[F.lit(str(i)) for i in range(13)]))) is None


def test_relevant_words(spark):
    w = lambda s: text.words(F.lit(s))
    assert one(spark, text.relevant_words(w("the Golf by audi"), w("golf"), w("audi golf"))) == "the golf by"
    assert one(spark, text.relevant_words(w("a new type"), w("golf"), w("audi"))) == "a new type"
    assert one(spark, text.relevant_words(w("in 1999"), w("golf"), w("audi"))) == "in 1999"
    assert one(spark, text.relevant_words(w("nothing here"), w("golf"), w("audi"))) is None


def test_keys(spark):
    import hashlib

    assert one(spark, text.key_of(F.lit(" a "), F.lit(None).cast("string"), F.lit(3))) == hashlib.md5(b"aNone3").hexdigest()


def test_parabola_and_growth(spark):
    p = [F.lit(float(x)) for x in (0, 1, 50, 6, 100, 21)]
    assert one(spark, maths.parabola(F.lit(70.0), *p)) == pytest.approx(10.8)
    assert one(spark, maths.parabola(F.lit(70.0), *p[:2], F.lit(0.0), *p[3:])) is None
    assert one(spark, maths.linear_outside(F.lit(120.0), *p)) == pytest.approx(27) and one(spark, maths.linear_outside(F.lit(70.0), *p)) == pytest.approx(10.8)
    assert one(spark, maths.growth(F.lit(0.05), F.lit(0.08))) == pytest.approx(0.264911, abs=1e-6)
    assert one(spark, maths.growth(F.lit(0.0), F.lit(0.08))) is None and one(spark, maths.growth(F.lit(-1.0), F.lit(0.08))) is None
    assert one(spark, maths.fuel_growth(F.lit(63.0), F.lit(63.0), F.lit(-5.0), F.lit(90.0))) == pytest.approx(1e-4 - 1)
    assert one(spark, maths.co2_growth(F.lit(63.0), F.lit(63.0), F.lit(-5.0), F.lit(90.0))) == -1
    assert one(spark, maths.truncated(F.lit(-1.239), 2)) == "-1.23" and one(spark, maths.truncated(F.lit(2.0), 2)) == "2.00"
    assert one(spark, maths.capped_co2(F.lit(3000.0), F.lit("diesel"))) == 2640 and one(spark, maths.capped_co2(F.lit(3000.0), F.lit("hay"))) == 3000


def test_projection(spark):
    lon, lat = F.lit(-79.387139), F.lit(43.642566)
    assert one(spark, geodesy.utm_zone(lon)) == 17 and one(spark, geodesy.utm_epsg(lon, lat)) == 32617
    e, n = (one(spark, c) for c in geodesy.utm_xy(lon, lat, F.lit(17)))
    assert e == pytest.approx(630084.30, abs=0.01) and n == pytest.approx(4833438.47, abs=0.01)
    assert one(spark, geodesy.great_circle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(111195, abs=1)


@pytest.mark.parametrize("lon1,lat1,lon2,lat2,metres", [
    (-73.8, 40.6, -0.5, 51.6, 5551759.400),  # published: New York to London
    (0.0, 0.0, 1.0, 0.0, 111319.4908), (0.0, 0.0, 0.0, 90.0, 10001965.7293), (179.5, 0.0, -179.5, 0.0, 111319.4908), (5.0, 5.0, 5.0, 5.0, 0.0), (10.0, -90.0, 50.0, 90.0, 20003931.4586),
])
def test_ellipsoid_distance(spark, lon1, lat1, lon2, lat2, metres):
    assert one(spark, geodesy.ellipsoid_distance(*map(F.lit, (lon1, lat1, lon2, lat2)))) == pytest.approx(metres, abs=0.001)


def test_nearly_opposite_places_and_nulls_have_a_distance(spark):
    far = one(spark, geodesy.ellipsoid_distance(*map(F.lit, (0.0, 0.1, 179.9, 0.0))))
    assert 19.9e6 < far < 20.1e6 and one(spark, geodesy.ellipsoid_distance(F.lit(None).cast("double"), *map(F.lit, (0.1, 179.9, 0.0)))) is None
