"""SimHash near-dedup: fingerprints linked by a binary trie self-join, grouped by connected components."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, give_memory_back, hot_join, materialize, small_batches

BITS = 64
SHINGLE = 3
SEED = 42
BUDGET = 3
#: Fingerprints of a bucket that one task joins at a time. A larger bucket is dealt to finer ones, at most LEVELS times; what
#: is still larger then, fingerprints that nearly all agree, is cut in parts, and each pair of parts is met.
PART, LEVELS = 2048, 3
#: Rows buffered before a traversal, and node pairs that it expands at once.
BUFFER, FRONTIER = 16_384, 1 << 18
#: Similar texts: words of a shingle, least cosine of the shingle counts, and the share of such pairs that share a bucket.
WIDE_SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.95
#: 64-bit words of a sketch, and the rows that a bucket should have at most on average.
SKETCH_WORDS, BUCKET_ROWS = 8, 64
#: Words whose hashes a worker remembers.
SEEN_WORDS = 100_000


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bytes of the bits that are 1 in over half of the rows of hashes, an array of bytes for each."""
    ones = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255 * 64):
        bits = np.unpackbits(hashes[at : at + 255 * 64], axis=1)
        bits = np.pad(bits, ((0, -len(bits) % 255), (0, 0))).reshape(-1, 255, bits.shape[1])
        ones += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; 0 without words. A bit is 1 if set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z alone, and white space [\x20\x09-\x0D] alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - width + 1].tolist()
    digest, ends = xxhash.xxh64_digest, ends[width - 1 :].tolist()
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)])
    return int.from_bytes(_majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", column: str = "fp") -> DataFrame:
    """docs with the fingerprint of text as a signed long."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def fp(batch: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in batch.to_pylist()], np.uint64).view(np.int64))

    return docs.withColumn(column, fp(F.col(text)))


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; parent leads to the least member."""
    while True:
        parent = _root(parent)
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def trie_links(prints: np.ndarray, group: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each fingerprint the index of the first of its class, where classes join those of one group that differ in at
    most budget bits. prints: rows of 64-bit words, distinct within a group and sorted by (group, print).

    The binary trie over a group is implicit: a node is a range of the sorted array. Pairs of nodes go down together
    from (root, root). A bit that differs costs one of the budget; a pair that has spent more is dropped with all below,
    and so is a pair of nodes all of whose fingerprints are known to be of one class. Two single fingerprints are compared
    at once, which walks the rest of both paths. Neighbours in order are compared first, as many of them are close.
    """
    prints = prints.reshape(len(prints), -1)
    n = len(prints)
    far = lambda x, y: np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int32)
    beside = np.flatnonzero(group[1:] == group[:-1])
    beside = beside[far(beside, beside + 1) <= budget]
    parent = _unite(np.arange(n), beside, beside + 1)
    runs = lambda: np.r_[0, np.cumsum(parent[1:] != parent[:-1])]  # noqa: E731  equal for a whole range of one class
    run = runs()
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many].astype(np.int32), hi[many].astype(np.int32)
    ones: dict[int, np.ndarray] = {}
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int16))]
    while stack:
        d, *pairs = stack.pop()
        if len(pairs[0]) > FRONTIER:
            half = len(pairs[0]) // 2
            stack += [(d, *(x[:half] for x in pairs)), (d, *(x[half:] for x in pairs))]
            continue
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum(prints[:, d // BITS] >> np.uint64(BITS - 1 - d % BITS) & np.uint64(1))].astype(np.int32)
        a0, a2, b0, b2, spent = pairs
        a1, b1 = (end - (ones[d][end] - ones[d][start]) for start, end in ((a0, a2), (b0, b2)))
        apart = a0 != b0  # (1, 0) would repeat (0, 1) for a node paired with itself
        cost = spent + np.int16(1)
        down = [
            (a0, a1, b0, b1, spent), (a1, a2, b1, b2, spent), (a0, a1, b1, b2, cost), (a1[apart], a2[apart], b0[apart], b1[apart], cost[apart]),
        ]
        a0, a2, b0, b2, spent = (np.concatenate(x) for x in zip(*down))
        alive = (a2 > a0) & (b2 > b0) & (spent <= budget) & ~((a0 == b0) & (a2 - a0 == 1))
        a0, a2, b0, b2, spent = (x[alive] for x in (a0, a2, b0, b2, spent))
        one = (run[a0] == run[a2 - 1]) & (run[b0] == run[b2 - 1]) & (parent[a0] == parent[b0])
        a0, a2, b0, b2, spent = (x[~one] for x in (a0, a2, b0, b2, spent))
        single = (a2 - a0 == 1) & (b2 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = far(x, y) <= budget
            if near.any():
                parent = _unite(parent, x[near], y[near])
                run = runs()
        if not single.all():
            stack.append((d + 1, *(x[~single] for x in (a0, a2, b0, b2, spent))))
    return _root(parent)


def _words_of(column: pa.Array) -> np.ndarray:
    """Fingerprints, longs or binaries of whole words, as rows of unsigned 64-bit words in bit order."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").reshape(len(column), -1).astype(np.uint64)


def _bucket_links(rows: DataFrame, budget: int) -> DataFrame:
    """(u, v) links of rows (key, fp) within each key: a class of k fingerprints gives k - 1 links, not all pairs."""

    def links(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        column = part["fp"].combine_chunks() if isinstance(part["fp"], pa.ChunkedArray) else part["fp"]
        fps, group = _words_of(column), part["key"].to_numpy()
        order = np.lexsort((*fps.T[::-1], group))
        first = trie_links(fps[order], group[order], budget)
        at = np.flatnonzero(first != np.arange(len(first)))
        ends = [column.take(pa.array(order[i])) for i in (at, first[at])]
        return pa.RecordBatch.from_arrays(ends, names=["u", "v"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BUFFER:
                rows = pa.Table.from_batches(held)
                last = rows["key"].to_numpy() == rows["key"][-1].as_py()  # its other rows may follow
                cut = len(rows) - int(last.sum())
                if cut:
                    yield links(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), len(rows) - cut
        if size:
            yield links(pa.Table.from_batches(held))
        held.clear()
        give_memory_back()

    kind = rows.schema["fp"].dataType.simpleString().replace("bigint", "long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(stream, f"u {kind}, v {kind}")


def _in_parts(rows: DataFrame, large: DataFrame, bucket: list[str], part: int) -> DataFrame:
    """(key, fp): rows of the large buckets, cut in parts by hash, one key for each pair of parts of a bucket."""
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = rows.join(large.withColumn("parts", F.ceil(F.col("count") / part).cast("int")), bucket).select(*bucket, "fp", F.inline(pairs))
    return dealt.select(F.xxhash64(*bucket, "i", "j").alias("key"), "fp")


def finer(mask: int, blocks: int) -> list[int]:
    """The masks that add one of so many blocks of the bits that mask leaves open. Fingerprints that agree on mask and differ
    in fewer bits than there are blocks agree on one of these."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i * len(free) // blocks : (i + 1) * len(free) // blocks]) for i in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def bucketed(prints: DataFrame, budget: int = BUDGET, part: int = PART, levels: int = LEVELS) -> DataFrame:
    """(key, fp): the distinct fingerprints (column fp) dealt to buckets so that any two within budget bits share one.

    Of budget + 1 blocks of bits, two near fingerprints agree on one at least, so each block's value is a bucket. Those of a
    bucket with over part rows are dealt anew by budget + 1 blocks of the bits that are left, and so on for so many levels: a
    row is copied at most budget + 1 times for each level, while buckets shrink by the value of a block. A bucket that is
    then still large is of fingerprints that agree nearly everywhere, and is cut in parts, each pair of which is a bucket.
    """
    masks, rows, out = [0], prints.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    for level in range(levels):
        next_masks = {m: finer(m, budget + 1) for m in masks}
        known = F.create_map(*[x for m, c in next_masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in c]))])
        rows = rows.select(F.explode(F.element_at(known, F.col("mask"))).alias("mask"), "fp")
        rows = (rows.distinct() if level else rows).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({m for c in next_masks.values() for m in c})
        large = materialize(rows.groupBy("mask", "value").count().filter(F.col("count") > part), "large-buckets")
        some = large.count() > 0
        small = rows.join(large, ["mask", "value"], "left_anti") if some else rows
        out.append(small.select(F.xxhash64("mask", "value").alias("key"), "fp"))
        if not some:
            break
        if level == levels - 1:
            out.append(_in_parts(rows, large, ["mask", "value"], part))
        else:
            rows = materialize(rows.join(large, ["mask", "value"], "left_semi").select("mask", "fp"), "large-rows")
    dealt = out[0]
    for more in out[1:]:
        dealt = dealt.unionByName(more)
    return dealt


def near_links(prints: DataFrame, budget: int = BUDGET, part: int = PART, levels: int = LEVELS) -> DataFrame:
    """(u, v) links that connect the distinct fingerprints (column fp) that are within budget bits, directly or through
    others: a trie over each bucket is joined with itself."""
    return _bucket_links(bucketed(prints, budget, part, levels), budget)


def _grouped(prints: DataFrame, node: str, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, node, component_id) for prints (id, node, more), a table: component_id is the least id of those that links
    (made of the distinct nodes) connect."""
    classes = prints.groupBy(node).agg(F.min("id").alias("least"), F.count("*").alias("size"), *[F.min(c).alias(c) for c in prints.columns if c not in ("id", node)])
    classes = materialize(classes, "fingerprint-classes")
    roots = components(links(classes))
    rooted = classes.select(node, "least", "size").join(roots, classes[node] == roots["node"], "left").select(classes[node].alias(node), "least", "size", F.coalesce(roots["root"], classes[node]).alias("root"))
    rooted = materialize(rooted, "rooted-classes")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    ids = hot_join(rooted, least, "root", "members", rooted.count()).select(node, "component_id", "size")
    return hot_join(prints.select("id", node), ids, node, "size", prints.count())


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: (key, fingerprint, component_id).

    fingerprint: 16 hex digits, see fingerprint(). Fingerprints within budget bits are linked, and component_id is the
    least key reachable over links. Null, empty and white texts have fingerprint zero and are linked like others; very long
    texts count whole. Null keys are never least (a class of null keys alone has a null id). Repeated rows repeat. No rows
    give no rows. Other columns are not read.
    """
    fps = materialize(with_fingerprint(docs.select(F.col(key).alias("id"), F.col(text).alias("body")), "body").select("id", "fp"), "fingerprints")
    out = _grouped(fps, "fp", lambda classes: near_links(classes.select("fp"), budget))
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_WORD = re.compile(r"[^\W_]+")


def _mixed(hashes: np.ndarray, first: int, many: int) -> np.ndarray:
    """For each hash so many others, those with the numbers from first on, as one row of bytes."""
    with np.errstate(over="ignore"):
        x = hashes[:, None] ^ (np.arange(first, first + many, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).view(np.uint8).reshape(len(hashes), -1)


def sketch(text: str | None, seen: dict[str, int], width: int, tables: int, bits: int) -> tuple[bytes, list[int]]:
    """(sketch, keys) of a whole text. The sketch is SKETCH_WORDS fingerprints of its shingles of words (runs of letters and
    digits in lower case; fewer than width words are one shingle, and a text without words is itself one). The keys are
    so many values of so many bits each from fingerprints of its distinct words. seen remembers words."""
    words = _WORD.findall((text or "").lower()) or [w for w in [(text or "").strip(" \t\n\x0b\x0c\r")] if w]
    if not words:
        return bytes(8 * SKETCH_WORDS), [0] * tables
    codes = []
    for w in words:
        h = seen.get(w)
        if h is None:
            if len(seen) > SEEN_WORDS:
                seen.clear()
            h = seen[w] = xxhash.xxh64_intdigest(w.encode())
        codes.append(h)
    codes = np.array(codes, np.uint64)
    width = min(width, len(codes))
    shingles = np.zeros(len(codes) - width + 1, np.uint64)
    for i in range(width):
        shingles = (shingles ^ codes[i : i + len(shingles)]) * np.uint64(0x9E3779B97F4A7C15)
        shingles ^= shingles >> np.uint64(29)
    parts = [_mixed(shingles, w, 1) for w in range(SKETCH_WORDS)]
    whole = np.concatenate([_majority(p) for p in parts])
    own = np.unique(codes)
    ones = np.unpackbits(np.concatenate([_majority(_mixed(own, SKETCH_WORDS + w, 1)) for w in range(-(-tables * bits // BITS))]))
    return whole.tobytes(), (ones[: tables * bits].reshape(tables, bits) @ (1 << np.arange(bits))).tolist()


def plan_tables(rows: int, width: int, similarity: float, recall: float) -> tuple[int, int]:
    """(tables, bits): how many keys of how many bits each text has. Bits follow the number of rows, so that a bucket has
    BUCKET_ROWS rows at most on average; tables follow the bits, so that the share recall of similar pairs has a key in
    common. A changed word breaks width shingles, so texts of that cosine in shingles have one of about similarity^(1/width)
    in words, and a bit of their fingerprints differs with the probability angle / pi."""
    bits = max(12, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))
    differs = math.acos(similarity ** (1 / width)) / math.pi
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differs) ** bits)), bits


def similar_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDE_SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(key, component_id), one row per row of docs: texts whose shingles of width words have a cosine of similarity or more
    are linked, and component_id is the least key reachable over links.

    near_dedup's three bits of 64 are texts that hardly differ. Here each text has a sketch of 8 x 64 bits, in which two
    texts differ in the share angle / pi, so the cosine is told to about 0.03; the budget of the trie is the bits that
    similarity allows for and one standard deviation, so that a pair at the threshold is rather linked than lost. No three bits of blocks help with so many, so buckets are keys drawn from fingerprints of words
    instead, see plan_tables: a pair at the threshold shares one with probability recall, a closer one more likely.
    Large buckets are cut in parts, each pair of which is met; equal sketches are merged first. Odd rows are as in near_dedup;
    a text without words is only linked to equal ones.
    """
    small_batches(docs.sparkSession)
    tables, bits = plan_tables(docs.count(), width, similarity, recall)
    differs, size = math.acos(similarity) / math.pi, BITS * SKETCH_WORDS
    budget = math.floor(size * differs + math.sqrt(size * differs * (1 - differs)))

    @F.arrow_udf("struct<sketch:binary,keys:array<long>>")
    def of_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, int] = {}
        for batch in batches:
            made = [sketch(t, seen, width, tables, bits) for t in batch.to_pylist()]
            columns = pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays(columns, names=["sketch", "keys"])
        seen.clear()
        give_memory_back()

    made = docs.select(F.col(key).alias("id"), of_text(F.col(text)).alias("made"))
    prints = materialize(made.select("id", "made.sketch", "made.keys"), "sketches")

    def links(classes: DataFrame) -> DataFrame:
        rows = classes.select(F.posexplode("keys").alias("table", "value"), F.col("sketch").alias("fp"))
        bucket = ["table", "value"]
        large = materialize(rows.groupBy(*bucket).count().filter(F.col("count") > PART), "large-buckets")
        dealt = rows.select(F.xxhash64(*bucket).alias("key"), "fp")
        if large.count():
            dealt = rows.join(large, bucket, "left_anti").select(F.xxhash64(*bucket).alias("key"), "fp").unionByName(_in_parts(rows, large, bucket, PART))
        return _bucket_links(dealt, budget)

    return _grouped(prints, "sketch", links).select(F.col("id").alias(key), "component_id")
