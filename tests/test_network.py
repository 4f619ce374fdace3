"""Networks of brands: gradients, learning, large brands, hot brands and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from tankline.operators import matching, network

PATTERNS = "brand string, tag string, pattern string"


def test_gradients_are_those_of_differences():
    draw = np.random.default_rng(1)
    net, x, y = network.Network([6, 8, 8, 4], 7), draw.integers(0, 2, (9, 6)).astype(float), draw.integers(0, 4, 9)
    _, found = net.gradients(x, y)
    for layer, g in zip(net.layers, found):
        for p, d in zip(layer, g):
            for at in np.ndindex(*p.shape):
                keep = p[at]
                p[at] = keep + 1e-6
                up = net.gradients(x, y)[0]
                p[at] = keep - 1e-6
                down = net.gradients(x, y)[0]
                p[at] = keep
                assert abs((up - down) / 2e-6 - d[at]) < 1e-5
    again = network.Network.from_bytes(net.to_bytes(), [6, 8, 8, 4])
    assert np.array_equal(again.forward(x)[-1], net.forward(x)[-1])


def test_a_network_for_each_brand_reaches_the_required_scores(spark):
    rows = [("VW", f"VW {n}", p) for n in ("Golf Plus", "Golf", "Polo", "Up") for p in (f"VW {n}", n, n.lower(), f"the {n.lower()} car")]
    rows += [("Audi", "Audi A4", "A4"), ("Audi", "Audi A4", "a4"), ("Solo", "Solo One", "one"), (None, "x", "y"), ("VW", None, "y"), ("VW", "VW Golf", None)]
    df = spark.createDataFrame(rows, PATTERNS)
    nets = network.train(df).cache()
    assert sorted((r.brand, r.part, len(r.tags)) for r in nets.collect()) == [("Audi", 0, 1), ("Solo", 0, 1), ("VW", 0, 4)]
    back = network.train(df.orderBy(F.desc("pattern")).repartition(5)).collect()
    assert {r.brand: bytes(r.weights) for r in back} == {r.brand: bytes(r.weights) for r in nets.collect()}
    texts = spark.createDataFrame([(1, "VW", "golf plus"), (2, "VW", "VW POLO"), (3, "VW", "nothing known"), (4, "BMW", "x"), (5, "VW", None), (6, "Audi", "a4"), (7, "VW", "golf plus")], "car_id int, brand string, text string")
    found = {}
    for r in network.scores(nets, texts).collect():
        found.setdefault(r.car_id, []).append((r.tag, r.score))
    assert [found[i][0][0] for i in (1, 2, 6, 7)] == ["VW Golf Plus", "VW Polo", "Audi A4", "VW Golf Plus"]
    assert found[1] == found[7] and found[1][0][1] > matching.REGISTER_SCORE and found[2][0][1] > matching.SENSOR_SCORE and not {4, 5} & set(found)


def test_large_brands_are_several_networks_and_hot_ones_several_tasks(spark, monkeypatch):
    rows = [("B", f"t{i}", f"word{i} common{i % 3}") for i in range(60)] + [("S", "s", "word")]
    df = spark.createDataFrame(rows, PATTERNS)
    nets = network.train(df, tags=25).cache()
    told = {r.part: r.tags for r in nets.filter("brand = 'B'").collect()}
    assert len(told) == 3 and all("" in t for t in told.values()) and sorted(x for t in told.values() for x in t if x) == sorted(f"t{i}" for i in range(60))
    texts = spark.createDataFrame([(i, "B", f"WORD{i} common{i % 3}") for i in range(60)], "car_id int, brand string, text string")
    monkeypatch.setattr(network, "TEXTS", 7)
    best = {r.car_id: r.tag for r in network.scores(nets, texts, keep=1).collect()}
    assert best == {i: f"t{i}" for i in range(60)}
