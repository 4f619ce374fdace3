"""The exact similarity filter against plain Python."""

import random
import re

from pyspark.sql import functions as F

from tankline.operators import matching, similarity
from tankline.plans import queries

SF = "/root/testdata/sf0.01"


def brute(a, b):
    a = a or ""
    b = b or ""
    years = [str(y) for y in range(1980, similarity.AS_OF + 1) if str(y) in a]
    a = a.replace(max(years), " ") if years else a
    plain = lambda s: s.replace("-", " ").strip().lower()
    bare = lambda s: re.sub(r"[(\[].*?[)\]]", "", s).replace("-", " ").strip()
    return similarity.alike_names(plain(a), plain(b), bare(a), bare(b))


def test_the_filter_tells_what_plain_python_tells(spark):
    draw = random.Random(3)
    words = ["golf", "Golf", "vw", "VW", "plus", "a4", "A-4", "2012", "(IV)", "[x y]", "é", "tdi", "variant", "grand", "tour", "ß", "x", "_", "日本", ".", "1.9"]

    def name():
        return draw.choice(["", " "]) + draw.choice([" ", "  ", "-"]).join(draw.choices(words, k=draw.randrange(0, 7)))

    def changed(s):
        s = list(s)
        for _ in range(draw.randrange(0, 4)):
            i = draw.randrange(len(s) + 1)
            s[i : i + draw.randrange(2)] = draw.choice(["", "q", " ", "e"])
        parts = "".join(s).split(" ")
        draw.random() < 0.3 and draw.shuffle(parts)
        return " ".join(parts)

    rows = [(n := name(), draw.choice([name, lambda: changed(n)])()) for _ in range(4000)] + [(None, "a b"), ("a b", None), ("a b", "a b")]  # noqa: B023
    rows = list({(i, *r) for i, r in enumerate(rows)})
    pairs = spark.createDataFrame(rows, "i int, a string, b string")
    expected = {i: brute(a, b) for i, a, b in rows}
    assert 300 < sum(expected.values()) < len(rows) - 300
    told = similarity.judgement(F.col("a"), F.col("b"))
    assert {r.i: r.alike for r in similarity.with_similarity(pairs, told).collect()} == expected
    both = similarity.with_similarity(pairs, told, similarity.judgement(F.col("b"), F.col("a")))
    assert {r.i: r.alike for r in both.collect()} == {i: expected[i] or brute(b, a) for i, a, b in rows}


def test_nine_of_ten_candidates_never_reach_python(spark):
    names = queries._distinct_names(spark, SF)
    from tankline.sources import adapters

    pairs = matching.name_matches(names, adapters.wiki_cars(spark, SF)).select("car_id", "tag").join(names, "car_id")
    told = pairs.select(similarity.open_comparisons(similarity.judgement(F.concat_ws(" ", "brand", "name"), F.col("tag"))).alias("j"))
    n, left = told.agg(F.count("*"), F.count_if(F.size("j.open") > 0)).first()
    assert n > 10_000 and left < n / 10
    plan = similarity.with_similarity(pairs, similarity.judgement(F.col("name"), F.col("tag")))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ArrowEvalPython.*\n.*Filter", plan)


def test_the_last_year_that_counts_is_the_caller_s(spark):
    row = spark.createDataFrame([("vw golf 2020",)], "a string")
    left = lambda year: row.select(similarity._undated(F.col("a"), None, year)).first()[0].split()
    assert left(2020) == ["vw", "golf"] and left(2019) == ["vw", "golf", "2020"]
