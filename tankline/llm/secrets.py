"""Secret scans: base patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

# The base kinds, their patterns and least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of 24 or more is the same as a run of any length that is then found long enough
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

#: At most so many different texts, those of least hash, give the labelled samples that the models are trained from.
SAMPLE_ROWS = 10_000
#: What counts as a candidate for the models, and the mean log-likelihood ratio for each character it must reach.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_RATIO = 1.5

_assign, _access, _hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_keyword = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)
_candidate, _word = re.compile(CANDIDATE), re.compile(r"[A-Za-z]{3,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, in code points, by start and then kind."""
    found = []
    if _keyword.search(text):
        found += [(*m.span(), "assign") for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _access.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in _hex.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class Markov:
    """Two first-order character models; ratio() is the mean log-likelihood ratio of random over ordinary, in nats."""

    def __init__(self, counts: np.ndarray, smooth: float = 0.5):
        """counts: [label, before, after], label 1 for random strings; characters are ASCII codes, 0 begins a string."""
        p = (counts + smooth) / (counts.sum(axis=2, keepdims=True) + smooth * counts.shape[2])
        self.table = np.log(p[1]) - np.log(p[0])

    def ratio(self, string: str) -> float:
        codes = np.frombuffer(b"\0" + string.encode("ascii", "replace"), np.uint8) & 127
        return float(self.table[codes[:-1], codes[1:]].mean())


def transitions(strings: list[str]) -> np.ndarray:
    """How often a character follows another in these strings, the begin of a string included."""
    codes = np.frombuffer(b"".join(b"\0" + s.encode("ascii", "replace") for s in strings), np.uint8) & 127
    out = np.bincount(codes[:-1].astype(np.int64) * 128 + codes[1:], minlength=128 * 128).reshape(128, 128) if len(codes) else np.zeros((128, 128), np.int64)
    out[:, 0] = 0
    return out


def ordinary(names: list[str], draw: random.Random) -> list[str]:
    """Strings as people write them: words joined in the styles of identifiers, with numbers, versions and acronyms, paths,
    dates and times, long numbers, and rules of one character."""
    out = []
    for i in range(0, len(names) - 3, 6):
        some = names[i : i + draw.randrange(2, 6)]
        low, high = [x.lower() for x in some], [x.capitalize() for x in some]
        number = str(draw.randrange(10 ** draw.randrange(1, 5)))
        style = draw.randrange(8)
        if style < 2:
            out.append(draw.choice("_-").join(low + [number] * (draw.random() < 0.4)))
        elif style == 2:
            out.append("".join(high) + number * (draw.random() < 0.3))
        elif style == 3:
            out.append("".join(x[:1] for x in some).upper() + "".join(high))
        elif style == 4:
            out.append("_".join(x.upper() for x in some))
        elif style == 5:
            out.append(low[0] + "".join(high[1:]) + number * (draw.random() < 0.3))
        else:
            out.append("/" * (draw.random() < 0.5) + "/".join(x + number * (draw.random() < 0.2) for x in low))
    for mark, between, inner in (("", "_", ""), ("-", draw.choice("T_-"), draw.choice(("-", "", "_")))):
        year, *rest = draw.randrange(1970, 2040), *(draw.randrange(1, n) for n in (13, 29, 24, 60, 60))
        day, time = mark.join((str(year), *(f"{x:02}" for x in rest[:2]))), inner.join(f"{x:02}" for x in rest[2:])
        out.append(f"{day}{between}{time}{draw.choice(('', '_' + day, '-backup', '-v2', 'Z', f'-{draw.randrange(1000):03}'))}")
    return [*out, str(draw.randrange(10 ** draw.randrange(4, 25))), draw.choice("_-=+/") * draw.randrange(4, 40), f"{draw.randrange(30)}-{draw.randrange(100)}-{draw.randrange(1000)}"]


def unforeseeable(draw: random.Random) -> list[str]:
    """Random strings over the alphabets that keys are written in."""
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = (digits + low + up, digits + low + up, digits + low + up + "+/", digits + low + up + "-_", digits + low, digits + up, digits + "ABCDEF")
    return ["".join(draw.choices(a, k=draw.randrange(16, 64))) for a in alphabets]


def labelled(text: str, seed: str, times: int = 1) -> tuple[list[str], list[str]]:
    """(ordinary, random) strings of one row: the words and other strings outside base spans, and what ordinary() makes of
    them; the values of base spans and what unforeseeable() draws. Draws are by seed, the text's hash, and so many times."""
    spans = base_spans(text)
    values = [text[a:b].split("=")[-1].strip("\"' :") for a, b, _ in spans]
    cut, at = [], 0
    for a, b, _ in spans:
        cut.append(text[at:a])
        at = max(at, b)
    names = _word.findall(" ".join([*cut, text[at:]]))
    plain, strange = list(names), list(values)
    for i in range(times):
        draw = random.Random(f"{seed}:{i}")
        plain += ordinary(draw.sample(names, len(names)) if i else names, draw)
        strange += unforeseeable(draw)
    return plain, strange


def train(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> Markov:
    """The models, from labelled strings of at most rows different texts, those of least hash; of fewer texts each gives more draws,
    so that the models are as well trained. Ids play no part, so rows that share one, or have none, are texts like others, and
    a text that is repeated counts once. Tasks count transitions and Spark adds them up; what comes to the driver is two tables
    of 128 x 128 counts, whatever the corpus holds. Without rows both models are flat."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("seed", F.xxhash64("text"))
    picked = materialize(texts.select("seed").distinct().orderBy("seed").limit(rows), "secret-sample")
    times = max(1, -(-rows // (4 * max(1, picked.count()))))
    sample = texts.join(F.broadcast(picked), "seed", "left_semi").groupBy("seed").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 128, 128), np.int64)
        for pdf in batches:
            for t, n in zip(pdf["text"], pdf["seed"]):
                for label, strings in enumerate(labelled(t, n, times)):
                    total[label] += transitions(strings)
        where = np.argwhere(total)
        yield pd.DataFrame({"label": where[:, 0], "a": where[:, 1], "b": where[:, 2], "n": total[tuple(where.T)]})

    counts = np.zeros((2, 128, 128))
    for r in sample.mapInPandas(count, "label int, a int, b int, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["a"], r["b"]] = r["n"]
    return Markov(counts)


def scan_text(text: str | None, model: Markov, min_ratio: float = MIN_RATIO) -> list[tuple[int, int, str]]:
    """All spans of a text: the base ones, and strings outside them that are likelier random than ordinary."""
    spans = base_spans(text or "")
    more, at, reach = [], 0, -1
    for m in _candidate.finditer(text or ""):
        while at < len(spans) and spans[at][0] < m.end():  # both lists go by start, so one pass meets them
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start() and model.ratio(m[0]) >= min_ratio:
            more.append((*m.span(), "random"))
    return sorted(spans + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else spans


def scan(docs: DataFrame, model: Markov, text: str = "text", min_ratio: float = MIN_RATIO, column: str = "secrets") -> DataFrame:
    """docs with an array of (kind, start, end), in code points, end exclusive, by start and then kind as KINDS has them.

    Whole texts are scanned where they lie, in time that follows their length. Null and empty texts have no span. Base
    spans of different kinds may overlap; spans that the models add never overlap a base one; a string whose ratio is just
    min_ratio is one. Repeated rows get the same. A
    column of that name is replaced, others come back as they are. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in scan_text(t, held.value, min_ratio)] for t in batch])

    return docs.withColumn(column, spans(F.col(text)))
