"""Source divergence audit: how the terms of a language's sources differ, from source to source and from their language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import again, byte_words, hot_join, materialize, small_batches

#: What a share of 1 is priced at.
SCALE = 1_000_000_000
#: Added to every count, twice to a total for each term.
PRIOR = 2
MIN_DOCS, TOP_TERMS = 10, 10
#: Entries that a task counts in memory before it hands them on.
COUNTED = 400_000
#: Terms of a language that one sorted array holds, in the mean; more terms are dealt over more blocks.
BLOCK = 1 << 14
#: Values of the shorter array that gallop together.
RUN = 256
#: From this total on numpy's 64 bits could overflow, and whole numbers of any size are used.
WIDE = 9_000_000_000_000_000
# Letters of ASCII in lower case and all bytes of other characters stand for themselves, the rest is blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d): occurrences and documents of each term of what a task reads, and a row without a term for
    each group, in portions."""
    n: dict[tuple[str, str], Counter] = {}
    d: dict[tuple[str, str], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            terms = [None, *(t.decode() for t in found)]
            counts = [[0, *found.values()], [0, *(d[lang, source][t] for t in found)]]
            columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)] + [pa.array(terms, pa.string())] + [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "d"])
        n.clear()
        d.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            own, docs, seen = n.setdefault((lang, source), Counter()), d.setdefault((lang, source), Counter()), set()
            for terms in byte_words(text.translate(_TERMS)):
                own.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(map(len, n.values())) > COUNTED:
            yield from rows()
    yield from rows()


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in short, in long) of the values that two sorted arrays share. A run of the shorter one gallops through the
    longer: its reach is doubled until the run's last value is passed, and the run is then looked up within it."""
    at, here, there = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, len(short), RUN):
        run, reach = short[first : first + RUN], RUN
        while at + reach < len(long) and long[at + reach] < run[-1]:
            reach *= 2
        window = long[at : at + reach + 1]
        place = np.searchsorted(window, run)
        hit = np.flatnonzero(place < len(window))
        hit = hit[window[place[hit]] == run[hit]]
        here.append(hit + first)
        there.append(place[hit] + at)
        at += int(place[-1])
    return np.concatenate(here), np.concatenate(there)


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)), exactly: by long division in base 1000."""
    whole = total + PRIOR * terms
    rest = counts.astype(object if whole > WIDE else np.int64) + PRIOR
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return (out + 1).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _merged(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """What the terms of one block that either of two groups has add to their divergence, and how many they are."""
    lang, a, b, _ = (k.as_py() for k in key)
    some = left if left.num_rows else right
    total_a, total_b, terms = (some.column(c)[0].as_py() for c in ("total_a", "total_b", "terms"))
    empty = np.zeros(0, np.int64)
    arrays = [[t.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("ids", "counts")] if t.num_rows else [empty, empty] for t in (left, right)]
    (ids_a, n_a), (ids_b, n_b) = arrays
    if len(ids_a) <= len(ids_b):
        in_a, in_b = gallop(ids_a, ids_b)
    else:
        in_b, in_a = gallop(ids_b, ids_a)
    p, q = prices(n_a, total_a, terms), prices(n_b, total_b, terms)
    zero = np.zeros(1, np.int64)
    p0, q0 = prices(zero, total_a, terms), prices(zero, total_b, terms)
    value = divergence(p[in_a], q[in_b]).sum() + divergence(np.delete(p, in_a), q0).sum() + divergence(p0, np.delete(q, in_b)).sum()
    return pa.table({"lang": [lang], "a": [a], "b": [b], "value": [int(value)], "met": [len(p) + len(q) - len(in_a)]})


def _price(count: str, total: str):
    return F.expr(f"1L + (cast({count} + {PRIOR} as decimal(20,0)) * {SCALE}) div nullif(cast({total} + {PRIOR} * terms as decimal(20,0)), 0)")


_VALUE = "((p - q) * (p - q)) div (p + q)"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has the divergence of each source from each other source of its
    language, part 'term' the top terms that a source has more of than its language, with what each adds to the divergence.

    A share is priced from smoothed counts, p = 1 + floor(SCALE (count + 2) / (total + 2 terms)), and two prices diverge by
    floor((p - q)^2 / (p + q)), in whole numbers. Terms are runs of ASCII letters, in lower case, and other characters than ASCII;
    those count that at least min_docs rows of the language have. Tasks count what they read before anything is shuffled, so a
    source with a third of all rows is a row a term and task. The terms of a language are dealt over blocks by hash; a group has
    a sorted array of (term id, count) for each block. Each unordered pair of groups is a task for each block, which merges their
    two arrays: a galloping intersection finds the shared terms, and prices these, those that one side has, and, over all blocks,
    those that neither has, once for both directions. So no task holds more than two blocks, and the number of pairs is that of
    the rows asked for, as each source is told its divergence from each other.

    Null texts, languages and sources read as ''. Each row is a document, repeated or not. A source without a counted term has
    count zero throughout; a language without any has value 0 for each pair. Ties rank by item. Other columns are left aside; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    asked = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    portions = asked.mapInArrow(_counted, "lang string, source string, term string, n long, d long")
    counts = materialize(portions.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts")
    groups = counts.filter("term is null").select("lang", "source")

    vocabulary = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("d").alias("docs")).filter(F.col("docs") >= min_docs)
    vocabulary = materialize(vocabulary.select("lang", "term", "n_lang", F.monotonically_increasing_id().alias("id")), "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    kept = materialize(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "kept-terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "rows", "terms", "total_lang"])
    groups = materialize(groups, "groups")

    all_rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    priced = hot_join(kept, groups, ["lang", "source"], "rows", all_rows).withColumns({"p": _price("n", "total"), "q": _price("n_lang", "total_lang")})
    more = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_VALUE).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = more.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / BLOCK)).alias("block")
    placed = hot_join(kept, groups.select("lang", "source", "terms", "rows"), ["lang", "source"], "rows", all_rows).select("lang", "source", block, F.struct("id", "n").alias("x"))
    sorted_rows = placed.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list("x")).alias("x"))
    arrays = materialize(sorted_rows.select("lang", "source", "block", F.col("x.id").alias("ids"), F.col("x.n").alias("counts")), "term-arrays")
    other = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    pairs = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "terms").join(other, "lang").filter("a < b")
    pairs = materialize(pairs, "group-pairs")
    side = lambda c: again(arrays).withColumnRenamed("source", c).join(again(pairs), ["lang", c]).groupBy("lang", "a", "b", "block")
    parts = side("a").cogroup(side("b")).applyInArrow(_merged, "lang string, a string, b string, value long, met long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    whole = pairs.join(sums, ["lang", "a", "b"], "left").fillna(0, ["value", "met"]).withColumns({"p": _price("0L", "total_a"), "q": _price("0L", "total_b")})
    absent = F.when(F.col("terms") > 0, F.expr(f"(terms - met) * ({_VALUE})")).otherwise(0)
    both = whole.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), (F.col("value") + absent).alias("value"))
    ranked = both.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(columns).unionByName(terms.select(columns))
