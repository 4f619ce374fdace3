"""A small network for each brand, from the words of a text to the page it is about; large brands are several networks."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .matching import MIN_PROBABILITY, word_features

# Two hidden layers of this width, passes over the patterns, and patterns of a step.
HIDDEN, EPOCHS, STEP = 8, 1000, 16
#: Steps at least, for brands of few patterns.
LEAST_STEPS = 6000
RATE, DECAYS, TINY = 0.01, (0.9, 0.999), 1e-8
#: Training ends early once the mean loss of a pass is below this.
ENOUGH = 2e-6
#: Tags of one network at most; a brand with more is dealt over several, each with a class for what is of none of its own, learned
#: from so many patterns of the others for each of its own.
TAGS, OTHERS = 500, 1.0
#: Texts that one task scores by a network.
TEXTS = 20_000
OTHER = ""


class Network:
    """Weights and biases of three layers; hidden layers are linear, the last one is a softmax over the tags."""

    def __init__(self, sizes: list[int], seed: int):
        draw = np.random.default_rng(seed)
        self.layers = [(draw.normal(0, 1 / np.sqrt(max(1, a)), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for w, b in self.layers:
            out.append(out[-1] @ w + b)
        z = np.exp(out[-1] - out[-1].max(axis=1, keepdims=True))
        out[-1] = z / z.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """The mean cross-entropy of the tags y and its gradients, back from the last layer to the first."""
        out = self.forward(x)
        at = np.arange(len(y))
        loss = float(-np.log(np.maximum(out[-1][at, y], 1e-300)).mean())
        delta = out[-1].copy()
        delta[at, y] -= 1
        delta /= len(y)
        found = []
        for (w, _), before in zip(reversed(self.layers), reversed(out[:-1])):
            found.append((before.T @ delta, delta.sum(axis=0)))
            delta = delta @ w.T
        return loss, found[::-1]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int = EPOCHS, step: int = STEP) -> None:
        draw, n = np.random.default_rng(seed), 0
        means = [[np.zeros_like(p) for p in layer] for layer in self.layers]
        squares = [[np.zeros_like(p) for p in layer] for layer in self.layers]
        for _ in range(max(epochs, -(-LEAST_STEPS // -(-len(y) // step)))):
            order, total = draw.permutation(len(y)), 0.0
            for first in range(0, len(y), step):
                some = order[first : first + step]
                loss, found = self.gradients(x[some], y[some])
                total += loss * len(some)
                n += 1
                rate = RATE * np.sqrt(1 - DECAYS[1] ** n) / (1 - DECAYS[0] ** n)
                for layer, m, s, g in zip(self.layers, means, squares, found):
                    for p, a, b, d in zip(layer, m, s, g):
                        a *= DECAYS[0]
                        a += (1 - DECAYS[0]) * d
                        b *= DECAYS[1]
                        b += (1 - DECAYS[1]) * d * d
                        p -= rate * a / (np.sqrt(b) + TINY)
            if total / len(y) < ENOUGH:
                break

    def to_bytes(self) -> bytes:
        return b"".join(p.astype("<f8").tobytes() for layer in self.layers for p in layer)

    @classmethod
    def from_bytes(cls, data: bytes, sizes: list[int]) -> Network:
        out, at = cls(sizes, 0), 0
        flat = np.frombuffer(data, "<f8")
        layers = []
        for a, b in zip(sizes, sizes[1:]):
            layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        out.layers = layers
        return out


def bags(texts: list[list[str]], words: list[str]) -> np.ndarray:
    """Which of words each text has, as 0 and 1."""
    known = {w: i for i, w in enumerate(words)}
    out = np.zeros((len(texts), len(words)))
    for i, t in enumerate(texts):
        out[i, [known[w] for w in t if w in known]] = 1
    return out


def _fitted(epochs: int):
    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        brand, part = key
        rows = rows.sort_values(["tag", "pattern"], kind="stable")  # however rows arrive, the same network
        words, tags = sorted({w for t in rows["words"] for w in t}), sorted(set(rows["tag"]))
        number = {t: i for i, t in enumerate(tags)}
        x, y = bags(list(rows["words"]), words), rows["tag"].map(number).to_numpy()
        seed = zlib.crc32(f"{brand}:{part}".encode())
        net = Network([len(words), HIDDEN, HIDDEN, len(tags)], seed)
        net.fit(x, y, seed, epochs)
        return pd.DataFrame({"brand": [brand], "part": [part], "words": [words], "tags": [tags], "weights": [net.to_bytes()]})

    return fit


def train(patterns: DataFrame, tags: int = TAGS, epochs: int = EPOCHS) -> DataFrame:
    """(brand, part, words, tags, weights): networks of the patterns (brand, tag, pattern), for each brand from the words of a
    pattern, without the brand's, through two layers of HIDDEN to a probability for each tag. Back-propagation with Adam, in
    steps of STEP patterns. A network is the same however its patterns arrive.

    A brand is a group of one task as long as it has at most that many tags. One with more is dealt by hash of the tag over
    several networks, of which each learns its own tags, and, as one class more, a sample of about as many patterns of the others,
    so that no task holds a large brand. Patterns of one tag stay together: the sentences of one page. Rows without brand, tag or
    pattern are left out; without patterns there is no network.
    """
    rows = word_features(patterns.filter("brand is not null and tag is not null and pattern is not null").select("brand", "tag", "pattern").distinct())
    sizes = rows.groupBy("brand").agg(F.countDistinct("tag").alias("n"), F.count("*").alias("rows")).select("brand", "rows", F.ceil(F.col("n") / tags).cast("int").alias("parts"))
    dealt = rows.join(sizes, "brand").withColumn("part", F.pmod(F.xxhash64("tag"), F.col("parts")).cast("int"))
    own = dealt.select("brand", "part", "tag", "pattern", "words")
    # a pattern is a counterexample of another part by its hash, so that each part gets about OTHERS times its own number
    shift = 1 + F.pmod(F.xxhash64("pattern", F.lit(1)), F.col("parts") - 1)
    others = dealt.filter("parts > 1").select("brand", F.pmod(F.col("part") + shift, F.col("parts")).cast("int").alias("part"), F.lit(OTHER).alias("tag"), "pattern", "words")
    if OTHERS < 1:
        others = others.filter(F.pmod(F.xxhash64("pattern", F.lit(2)), F.lit(1000)) < int(1000 * OTHERS))
    return own.unionByName(others).groupBy("brand", "part").applyInPandas(_fitted(epochs), "brand string, part int, words array<string>, tags array<string>, weights binary")


def _scored(texts: pa.Table, networks: pa.Table) -> pa.Table:
    """(brand, text, tag, score) above the least probability, of texts (brand, text, words) by one network."""
    columns = {"brand": [], "text": [], "tag": [], "score": []}
    if texts.num_rows and networks.num_rows:
        words, tags = (networks.column(c)[0].as_py() for c in ("words", "tags"))
        net = Network.from_bytes(networks.column("weights")[0].as_py(), [len(words), HIDDEN, HIDDEN, len(tags)])
        found = net.forward(bags(texts.column("words").to_pylist(), words))[-1]
        brand, text = (texts.column(c).to_pylist() for c in ("brand", "text"))
        for i, j in np.argwhere(found > MIN_PROBABILITY).tolist():
            if tags[j] != OTHER:
                for c, v in zip(columns.values(), (brand[i], text[i], tags[j], found[i, j])):
                    c.append(v)
    return pa.table(columns, schema=pa.schema([("brand", pa.string()), ("text", pa.string()), ("tag", pa.string()), ("score", pa.float64())]))


def scores(networks: DataFrame, texts: DataFrame, keep: int = 10) -> DataFrame:
    """(car_id, brand, text, tag, score): the tags above the least probability for each text (car_id, brand, text), at most keep,
    best first. Each distinct text of a brand is asked once, and a brand's texts are dealt over as many tasks as they need. A text
    without a known word gets what the network says of no words; texts of unknown brands, and null ones, get nothing."""
    own = word_features(texts.filter("text is not null").select("brand", "text").distinct(), "text")
    salts = own.groupBy("brand").agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("salts"))
    salted = own.join(salts, "brand").withColumn("salt", F.pmod(F.xxhash64("text"), F.col("salts")).cast("int"))
    parts = networks.select("brand", "part")
    left = salted.join(parts, "brand").select("brand", "part", "salt", "text", "words")
    right = networks.join(salts.withColumnRenamed("brand", "b"), F.col("brand") == F.col("b")).select("brand", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "words", "tags", "weights")
    left, right = kept(left, "asked-texts"), kept(right, "networks")
    key = ["brand", "part", "salt"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_scored, "brand string, text string, tag string, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("brand", "text").orderBy(F.desc("score"), "tag"))).filter(F.col("rank") <= keep)
    return texts.select("car_id", "brand", "text").join(ranked.select("brand", "text", "tag", "score"), ["brand", "text"]).select("car_id", "brand", "text", "tag", "score")
