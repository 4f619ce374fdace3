"""Matching queries where many cars and many pages have one name: nothing may have a row for each car and page."""

import datetime

import pytest
from pyspark.sql import functions as F

from tankline.operators import matching
from tankline.plans import registry

N = 300


@pytest.fixture(scope="module")
def one_name(spark, tmp_path_factory):
    """A folder of tables with N parts of one name and a car of each."""
    root = str(tmp_path_factory.mktemp("one-name"))
    part = spark.range(N).select(F.col("id").alias("p_partkey"), F.lit("large ring").alias("p_name"), F.lit("Brand#2").alias("p_brand"), F.lit("PROMO").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(f"{root}/part.parquet")
    line = spark.range(N).select(F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), *[F.lit(1.0).alias(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax")])
    line.withColumns({"l_returnflag": F.lit("A"), "l_linestatus": F.lit("F"), "l_shipdate": F.lit(datetime.datetime(1996, 5, 1))}).write.parquet(f"{root}/lineitem.parquet")
    return root


def most_rows(df):
    """The rows of the step of a plan that has most of them, once it has run."""
    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().get("numOutputRows")
        below = [walk(node.children().apply(i)) for i in range(node.children().size())]
        return max([own.get().value() if own.isDefined() else 0, *below])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["match_register", "curated_list", "match_register_scored", "match_register_network", "match_sensor", "review_queue", "matched_ratio", "match_sensor_scored", "match_sensor_network"])
def test_pages_of_one_name_are_not_repeated_for_each_car(spark, one_name, name):
    found = registry.QUERIES[name](spark, one_name)
    rows = found.collect()
    assert most_rows(found) <= 4 * N
    if name == "matched_ratio":
        assert [r.matched_ratio for r in rows] == [1.0]
    elif name == "review_queue":
        assert [(r.cars, r.matched, r.pages) for r in rows] == [(N, True, N)]
    else:
        assert len(rows) == N and {r.pages for r in rows} == {N}


def test_cars_with_several_names_have_the_pages_of_all(spark):
    wiki = spark.createDataFrame([("h1", "VW Golf", "VW", "Golf"), ("h2", "VW Golf", "VW", "x"), ("h3", "VW Polo", "VW", "Polo"), ("h4", "Audi A4", "Audi", "A4")], "hash_id string, wiki_name string, brand_name string, car_name string")
    rows = [("a", "VW", "golf", 2001, ""), ("a", "VW", "polo", 2001, ""), ("b", "VW", "golf", 2001, ""), ("b", "VW", "golf", 2001, ""), ("c", "VW", "golf gti", 1, ""), ("c", "VW", "polo", 1, ""), ("d", "Audi", "s1", 1990, ""), ("d", "VW", "golf", None, ""), ("e", "VW", "up", 1, ""), ("f", None, "golf", None, "")]
    cars = spark.createDataFrame(rows, "car_id string, brand string, name string, year int, description string")
    curated = spark.createDataFrame([("Audi", "s11990", "Audi A4")], "brand string, entry string, wiki_name string")
    found = matching.register_names(cars, wiki, curated)
    each = {("a", 1, "h1"), ("a", 1, "h3"), ("b", 1, "h1"), ("c", 1, "h3"), ("d", 0, "h4")}
    assert {tuple(r) for r in found.each().collect()} == each and found.each().count() == len(each)
    told = found.per_car(F.count("*").alias("pages"), F.min("hash_id").alias("first"))
    assert sorted(tuple(r) for r in told.collect()) == [("a", 1, 2, "h1"), ("b", 1, 1, "h1"), ("c", 1, 1, "h3"), ("d", 0, 1, "h4")]
    queue = {(r.brand, r.name): (r.cars, r.matched, r.pages) for r in matching.names_queue(found).collect()}
    plain = {(r.brand, r.name): (r.cars, r.matched, r.pages) for r in matching.review_queue(cars, found.each()).collect()}
    assert queue == plain and len(queue) == 6
