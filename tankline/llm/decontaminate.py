"""Benchmark decontamination with DataFrame functions only: MinHash containment search by size, exact verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORDS = 5
CONTAINMENT = 0.8
#: Shingles of a benchmark, or candidate documents, that are broadcast at once (some 50 MB).
BROADCAST_ROWS = 400_000


def words(text):
    """The runs of letters and digits of a text in lower case, so that marks between words don't hide a passage."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def shingles(df: DataFrame, width: int) -> DataFrame:
    """A row for each shingle of the column words (its place is at, none for fewer words than width)."""
    last = F.size("words") - width
    return df.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))


def _shingle(width: int) -> list:
    return [F.get("words", F.col("at") + i) for i in range(width)]


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", width: int = WORDS, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS, least_words: int = 1) -> DataFrame:
    """(key, item_key, n_shared, n_shingles, containment): the items of which a document has at least that share of the
    distinct shingles, one row for each such pair of ids.

    Items are partitioned by the power of two that bounds their number of shingles u. An item's sketch is its s least
    shingle hashes, s = 2 floor((1 - containment) u) + 1, or all. A document with the containment lacks at most
    floor((1 - containment) n) of the item's n shingles, so it has at least s less that number of the sketch: looking
    the sketch up in the documents loses no pair, however long the document is. Candidates are then verified on the
    words themselves. An item of fewer words than width has one shingle, all its words, and is found where these stand
    together; such items are searched apart, once for each number of words that occurs. As so short a passage can turn up by
    chance, least_words leaves out shorter items. Null and empty items are found nowhere, and such documents hold nothing. Rows that repeat a key are judged by themselves; the best one's figures
    are returned. Other columns are not read. Empty tables give no rows.

    Very long texts are searched whole. Documents are never shuffled: the shingles of the items are broadcast, and only hits and candidates move. A benchmark
    of over broadcast_rows shingles is cut in slices of items, each of which is broadcast to its own pass over docs.
    """
    named = items.select(F.col(item_key).alias("item"), words(F.col(item_text)).alias("words")).filter(F.size("words") >= max(1, least_words))
    found = named.agg(F.collect_set(F.least(F.size("words"), F.lit(width)))).first()[0]  # at most width numbers
    of_width = lambda w: named.filter(F.size("words") >= w if w == width else F.size("words") == w)
    pairs = [p for w in found or [width] for p in _of_width(docs, of_width(w), text, key, w, containment, broadcast_rows)]
    best = reduce(DataFrame.unionByName, pairs).groupBy(F.col("id").alias(key), F.col("item").alias(item_key)).agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def _of_width(docs: DataFrame, named: DataFrame, text: str, key: str, width: int, containment: float, broadcast_rows: int) -> list[DataFrame]:
    """_pairs of each slice of the items named, by shingles of width words."""
    listed = shingles(named, width).select("item", F.xxhash64(*_shingle(width)).alias("h"), F.array(*_shingle(width)).alias("shingle"))
    listed = materialize(listed.distinct(), "item-shingles")
    rows, distinct = listed.agg(F.count("*"), F.countDistinct("item")).first()
    slices = max(1, min(distinct, -(-rows // max(1, broadcast_rows))))
    of_slice = lambda i: listed.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == i) if slices > 1 else listed
    return [_pairs(docs, of_slice(i), text, key, width, containment, broadcast_rows) for i in range(slices)]


def _pairs(docs: DataFrame, listed: DataFrame, text: str, key: str, width: int, containment: float, broadcast_rows: int) -> DataFrame:
    """(id, item, n_shared, n_shingles) of the rows of docs that contain an item of listed (item, h, shingle)."""
    sizes = listed.groupBy("item").agg(F.sort_array(F.collect_set("h")).alias("hashes"), F.countDistinct("shingle").alias("n"))
    spare = F.floor((1 - F.lit(containment)) * F.pow(2.0, F.ceil(F.log2(F.col("n").cast("double")))) + 1e-9)
    lacking = F.floor((1 - F.lit(containment)) * F.col("n") + 1e-9)
    sizes = sizes.withColumn("s", F.least(2 * spare + 1, F.size("hashes").cast("long")).cast("int")).withColumn("need", F.greatest(F.col("s") - lacking - (F.col("n") - F.size("hashes")), F.lit(1)))
    sketches = materialize(sizes.select("item", "n", "need", F.slice("hashes", F.lit(1), F.col("s")).alias("sketch")), "sketches")
    sketch_rows = sketches.select("item", F.explode("sketch").alias("h"))

    whole = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("body"))
    probes = shingles(whole.select("id", "row", words(F.col("body")).alias("words")), width).select("id", "row", F.xxhash64(*_shingle(width)).alias("h"))
    hits = probes.join(F.broadcast(sketch_rows), "h").groupBy("id", "row", "item", "h").agg(F.lit(1).alias("one"))
    hits = hits.groupBy("id", "row", "item").agg(F.count("*").alias("hits"))
    candidates = materialize(hits.join(F.broadcast(sketches.select("item", "n", "need")), "item").filter("hits >= need").select("id", "row", "item", "n"), "candidates")

    suspects = candidates.select("row").distinct()
    few = suspects.count() <= broadcast_rows
    again = whole.join(F.broadcast(suspects), "row", "left_semi") if few else whole
    texts = shingles(again.select("id", "row", words(F.col("body")).alias("words")), width).select("id", "row", F.xxhash64(*_shingle(width)).alias("h"), F.array(*_shingle(width)).alias("found"))
    shared = texts.join(F.broadcast(listed), "h").filter("found = shingle").groupBy("id", "row", "item", "shingle").agg(F.lit(1).alias("one"))
    shared = shared.groupBy("id", "row", "item").agg(F.count("*").alias("n_shared"))
    same = [shared[c].eqNullSafe(candidates[c]) for c in ("id", "row", "item")]
    pairs = shared.join(candidates, same[0] & same[1] & same[2]).select(shared["id"].alias("id"), shared["item"].alias("item"), "n_shared", F.col("n").alias("n_shingles"))
    return pairs.filter(F.col("n_shared") >= F.ceil(F.lit(containment) * F.col("n_shingles") - 1e-9))
