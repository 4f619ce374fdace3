"""String similarity of names, exact: bounds by built-in functions first, and Python for the comparisons that they leave open."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import folded, without_brackets, words, year_in_name
from ..sources.sinks import kept

# Ratios that names must exceed, rounded to whole numbers: as they are, and without brackets or in any order of words.
RATIO, STRICT_RATIO = 90, 93
#: The last year that counts as one in a name, unless the caller says another.
AS_OF = 2030


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence of characters: a bit is cleared for each character that it gains."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        here = row & places.get(y, 0)
        row = (row + here | row - here) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 x 2 matches / total length, from the longest common subsequence of characters."""
    if not a or not b:
        return 0.0 if a or b else 100.0
    return 200.0 * common(a, b) / (len(a) + len(b))


def _tokens(s: str) -> list[str]:
    return re.sub(r"\W+", " ", s.lower()).split()


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(_tokens(a))), " ".join(sorted(_tokens(b))))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and the common words with either side's others."""
    x, y = set(_tokens(a)), set(_tokens(b))
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(s - t))}".strip() for s, t in ((x, y), (y, x)))
    return max(ratio(both, left), ratio(both, right), ratio(left, right)) if both else ratio(left, right)


def alike_names(a: str, b: str, clean_a: str, clean_b: str) -> bool:
    """The rule in plain Python: what the functions below are held against."""
    if any(len(re.findall(r"\w+", s)) <= 1 for s in (a, b, clean_a, clean_b)):
        return False
    pairs = ((a, b), (clean_a, clean_b))
    return round(ratio(a, b)) > RATIO or round(ratio(clean_a, clean_b)) > STRICT_RATIO or any(round(f(*p)) > STRICT_RATIO for f in (token_sort_ratio, token_set_ratio) for p in pairs)


def _need(total: Column, least: int) -> Column:
    """The common characters that two names of that many together need so that their ratio, rounded to even, exceeds least: 2 x 100
    x common / total over least + 0.5, or just that where it is rounded up."""
    exact = total.cast("long") * (2 * least + 1) / 400
    return (F.floor(exact) + 1 if least % 2 == 0 else F.ceil(exact)).cast("int")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _grams(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))


def _comparison(x: Column, y: Column, least: int) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), _need(F.length(x) + F.length(y), least).alias("need"))


def possible(c: Column) -> Column:
    """Whether a comparison (x, y, need) can succeed. What two names have in common is no longer than either. A character of x that
    is left out takes at most two of x's pairs of neighbours with it, one of y that is put in parts at most one; so of the
    different pairs of x at most so many can lack in y, and the other way round. No comparison that succeeds is ruled out."""
    out_x, out_y = F.length(c["x"]) - c["need"], F.length(c["y"]) - c["need"]
    lacking = lambda g, a, b: F.size(F.array_except(g[a], g[b]))
    both = F.struct(_grams(c["x"]).alias("x"), _grams(c["y"]).alias("y"), out_x.alias("out_x"), out_y.alias("out_y"))
    few = _let(both, lambda g: (lacking(g, "x", "y") <= 2 * g["out_x"] + g["out_y"]) & (lacking(g, "y", "x") <= 2 * g["out_y"] + g["out_x"]))
    return F.when((out_x >= 0) & (out_y >= 0), few).otherwise(False)


def _undated(left: Column, year: Column | None, as_of: int | Column) -> Column:
    if year is not None:
        left = F.coalesce(F.replace(left, year.cast("string"), F.lit(" ")), left)
    return _let(left, lambda n: F.coalesce(F.replace(n, year_in_name(n, as_of).cast("string"), F.lit(" ")), n))


def judgement(left: Column, right: Column, year: Column | None = None, as_of: int | Column = AS_OF) -> Column:
    """(certain, asked): whether two names are surely alike, and else the comparisons (x, y, need) of which one must succeed, but
    for those that lengths rule out; none means that they aren't alike.

    Names are alike that are equal but for a tenth of their characters, in any order of words, or one's words among the other's,
    by ratios rounded to whole numbers. The latest year up to as_of that is in the left name is taken out of it, and so is year; both
    must have two words, with and without what is in brackets. Each step's names are worked out once.
    """
    plain = lambda c: folded(F.replace(c, F.lit("-"), F.lit(" ")))
    joined = lambda w: F.array_join(F.array_sort(w), " ")
    nothing = F.array().cast("array<struct<x:string,y:string,need:int>>")

    def names(n: Column) -> Column:
        return F.struct(plain(n["l"]).alias("a"), plain(n["r"]).alias("b"), without_brackets(n["l"]).alias("ca"), without_brackets(n["r"]).alias("cb"))

    def with_words(n: Column) -> Column:
        return F.struct(*[n[c].alias(c) for c in ("a", "b", "ca", "cb")], *[words(n[c]).alias(f"w{c}") for c in ("a", "b", "ca", "cb")])

    def sides(n: Column, x: str, y: str) -> Column:
        own, other = F.array_distinct(n[x]), F.array_distinct(n[y])
        both = joined(F.array_intersect(own, other))
        return _let(F.struct(both.alias("both"), joined(F.array_except(own, other)).alias("s"), joined(F.array_except(other, own)).alias("t")), lambda v: F.struct(
            v["both"].alias("both"), F.trim(F.concat_ws(" ", v["both"], v["s"])).alias("x"), F.trim(F.concat_ws(" ", v["both"], v["t"])).alias("y")))

    def with_sides(n: Column) -> Column:
        return F.struct(n.alias("n"), F.array(sides(n, "wa", "wb"), sides(n, "wca", "wcb")).alias("sets"))

    def asked(v: Column) -> Column:
        n = v["n"]
        each = [_comparison(n["a"], n["b"], RATIO), _comparison(n["ca"], n["cb"], STRICT_RATIO), _comparison(joined(n["wa"]), joined(n["wb"]), STRICT_RATIO), _comparison(joined(n["wca"]), joined(n["wcb"]), STRICT_RATIO)]
        each += [_comparison(v["sets"][i]["x"], v["sets"][i]["y"], STRICT_RATIO) for i in range(2)]
        # the common words begin either side, so what they have in common with it is themselves
        reached = lambda t, side: 400 * F.length(t["both"]) >= (2 * STRICT_RATIO + 1) * (F.length(t["both"]) + F.length(t[side]))
        within = F.exists(v["sets"], lambda t: (F.length(t["both"]) > 0) & (reached(t, "x") | reached(t, "y")))
        return F.struct(within.alias("within"), F.array(*each).alias("each"))

    def told(v: Column) -> Column:
        certain = v["within"] | F.exists(v["each"], lambda c: c["x"] == c["y"])
        open_ = F.filter(v["each"], lambda c: F.least(F.length(c["x"]), F.length(c["y"])) >= c["need"])
        return F.struct(certain.alias("certain"), F.when(certain, nothing).otherwise(open_).alias("asked"))

    given = F.struct(_undated(F.coalesce(left, F.lit("")), year, as_of).alias("l"), F.coalesce(right, F.lit("")).alias("r"))

    def judged(n: Column) -> Column:
        enough = F.forall(F.array(*[F.size(n[f"w{c}"]) for c in ("a", "b", "ca", "cb")]), lambda k: k > 1)
        return F.when(enough, _let(_let(with_sides(n), asked), told)).otherwise(F.struct(F.lit(False).alias("certain"), nothing.alias("asked")))

    return _let(_let(_let(given, names), with_words), judged)


def open_comparisons(*judgements: Column) -> Column:
    """(certain, open) of several judgements: whether one is certain, and else their different comparisons that can succeed."""
    together = F.struct(F.exists(F.array(*[j["certain"] for j in judgements]), lambda c: c).alias("certain"), F.array_distinct(F.flatten(F.array(*[j["asked"] for j in judgements]))).alias("asked"))
    nothing = F.array().cast("array<struct<x:string,y:string,need:int>>")
    return _let(together, lambda t: F.struct(t["certain"].alias("certain"), F.when(t["certain"], nothing).otherwise(F.filter(t["asked"], possible)).alias("open")))


@F.arrow_udf(BooleanType())
def one_succeeds(comparisons: pa.Array) -> pa.Array:
    """Whether one of each row's comparisons (x, y, need) has that much in common; the first that has ends the search."""
    flat = comparisons.flatten()
    x, y, need = (flat.field(i).to_pylist() for i in range(3))
    out, at = [], 0
    for n in comparisons.value_lengths().to_pylist():
        out.append(any(common(x[i], y[i]) >= need[i] for i in range(at, at + (n or 0))))
        at += n or 0
    return pa.array(out, pa.bool_())


def with_similarity(pairs: DataFrame, *judgements: Column, column: str = "alike") -> DataFrame:
    """pairs with a boolean column: whether one of judgements (see judgement) says that two names are alike.

    Pairs are judged by built-in functions, once, and stored; only those with open comparisons go to Python, all their
    comparisons in one call, and no others pass through it.
    """
    each = F.array(*judgements)  # worked out once
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a pair is few bytes and much work
    told = kept(pairs.repartition(tasks).withColumn("judged", _let(each, lambda e: open_comparisons(*[e[i] for i in range(len(judgements))]))), "judged-pairs")
    known = F.col("judged.certain") | (F.size("judged.open") == 0)
    closed = told.filter(known).withColumn(column, F.col("judged.certain"))
    asked = told.filter(~known).withColumn(column, one_succeeds(F.col("judged.open")))
    return closed.unionByName(asked).drop("judged")
