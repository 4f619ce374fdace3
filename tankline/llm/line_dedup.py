"""Line dedup: a sharded minimal perfect hash over line hashes indexes fingerprint and count arrays that documents probe."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize, own_columns, small_batches

#: Line hashes in one shard, about; the whole index is broadcast up to so many bytes, and beyond is met shard by shard.
SHARD_KEYS = 500_000
BROADCAST_BYTES = 96 << 20
#: Beyond, lines that one task should meet in a shard, about; a shard that has more is met by more tasks.
TASK_LINES = 1_000_000
#: Beyond, rows with the same text are dealt over so many tasks when they meet their dropped lines.
SALTS = 32
MAX_LEVELS = 24
MOST = (1 << 32) - 1


class PerfectHash:
    """A minimal perfect hash over distinct (h1, h2) line hashes, with 32 bits each of a fingerprint (of h2) and a count
    (clipped to what they hold) for each slot.

    h1 picks the slot: level after level, keys that are alone in their bit keep it, others go on; the slot is the
    rank of the bit. Keys that share h1, or are left after the last level, are also listed aside with both hashes, so a key that
    was added always has its own count. One that never was meets another's fingerprint, and passes it once in 2^32.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray):
        order = np.argsort(h1, kind="stable")
        h1, h2, counts = h1[order], h2[order], counts[order]
        again = np.r_[False, h1[1:] == h1[:-1]]
        self.levels, left, slots = [], np.flatnonzero(~again), []
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            words = (2 * len(left) >> 6) + 1
            at = self._place(h1[left], level, words)
            alone = np.bincount(at, minlength=words << 6) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = np.r_[0, np.cumsum(np.bitwise_count(bits).astype(np.int64))] + sum(map(len, slots))
            kept = alone[at]
            slots.append(left[kept][np.argsort(at[kept])])
            self.levels.append((bits, ranks.astype(np.uint32)))
            left = left[~kept]
        order = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        self.prints, self.counts = (h2[order] & np.uint64(MOST)).astype(np.uint32), np.minimum(counts[order], MOST).astype(np.uint32)
        rest = np.r_[np.flatnonzero(again | np.r_[again[1:], False][: len(again)]), left].astype(np.int64)
        self.rest = {(int(a), int(b)): min(int(c), MOST) for a, b, c in zip(h1[rest], h2[rest], counts[rest])}

    @staticmethod
    def _place(h1: np.ndarray, level: int, words: int) -> np.ndarray:
        x = (h1 ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return (x % np.uint64(words << 6)).astype(np.int64)

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each line hash, 0 for those never added."""
        found, left = np.zeros(len(h1), np.int64), np.arange(len(h1))
        for level, (bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(h1[left], level, len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            slot = ranks[at[hit] >> 6].astype(np.int64) + below
            found[left[hit]] = np.where(self.prints[slot] == (h2[left[hit]] & np.uint64(MOST)).astype(np.uint32), self.counts[slot], 0)
            left = left[~hit]
        if self.rest:
            aside = np.isin(h1, np.array([a for a, _ in self.rest], np.uint64))
            for i in np.flatnonzero(aside):
                found[i] = self.rest.get((int(h1[i]), int(h2[i])), 0)
        return found


def line_key(line):
    """The key of a line: no white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h1, h2, n): the 128-bit hashes of all distinct line keys, and the rows that have them. Each row counts a key once."""
    keys = F.array_distinct(F.transform(F.split(F.col(text), "\n", -1), line_key))
    lines = docs.select(F.explode(keys).alias("k")).filter("k <> ''")
    return lines.groupBy(F.xxhash64("k").alias("h1"), F.xxhash64("k", "k").alias("h2")).agg(F.count("*").alias("n"))


def build_index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The shards of the index as a table (shard, lines, index), and their number. A shard is built in one task from a
    bounded share of the hashes, as these are distinct and spread evenly; lines is how many will be looked up in it."""
    counts = materialize(counts, "line-hashes")
    shards = max(1, -(-counts.count() // shard_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (pdf[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "lines": [int(pdf["n"].sum())], "index": [pickle.dumps(PerfectHash(h1, h2, pdf["n"].to_numpy()))]})

    parts = counts.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard")
    return materialize(parts.applyInPandas(build, "shard int, lines long, index binary"), "line-index"), shards


def _hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a line has a key, and the key's two hashes, the same as line_counts has."""
    digest, white = xxhash.xxh64_intdigest, SPACES.encode()
    keys = [x.strip(white).lower() for x in lines]
    first = [digest(k, 42) for k in keys]
    second = [digest(k, h) for k, h in zip(keys, first)]
    return np.array([k != b"" for k in keys], bool), np.array(first, np.uint64), np.array(second, np.uint64)


def _keep(texts: list[str | None], dropped) -> pd.DataFrame:
    """The texts without their dropped lines; dropped(lines) says which of the lines of all texts go."""
    split = [(t or "").encode().split(b"\n") for t in texts]
    gone = dropped([x for lines in split for x in lines])
    out, at = [], 0
    for lines in split:
        g = gone[at : at + len(lines)]
        at += len(lines)
        kept = [x for x, drop in zip(lines, g) if not drop] if g.any() else lines
        out.append((b"\n".join(kept).decode(), len(lines), int(g.sum())))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


_RESULT = "text string, n_lines long, n_dropped long"


def _probe_all(docs: DataFrame, text: str, index: DataFrame, shards: int, min_docs: int):
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({r["shard"]: bytes(r["index"]) for r in index.collect()})

    @F.pandas_udf(_RESULT)
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = {k: pickle.loads(v) for k, v in held.value.items()}

        def dropped(lines: list[bytes]) -> np.ndarray:
            real, h1, h2 = _hashes(lines)
            counts, shard = np.zeros(len(lines), np.int64), h1.view(np.int64) % shards
            for k, part in index.items():
                at = np.flatnonzero(shard == k)
                counts[at] = part.count(h1[at], h2[at])
            return real & (counts >= min_docs)

        for batch in batches:
            yield _keep(batch.tolist(), dropped)

    return docs.withColumn("lines", probe(F.col(text)))


def _probe_shards(docs: DataFrame, text: str, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """For an index too large to broadcast: line hashes of distinct texts, not texts, go to their shard and meet it there.

    A shard goes to as many tasks as its lines need, known from its counts, so a line that is in a third of all documents
    is met by many tasks, which hold one shard and a batch at a time. What comes back is the set of dropped hashes of each
    text that has any; rows with one text are dealt over SALTS tasks when they meet it.
    """
    keys = F.transform(F.split(F.col(text), "\n", -1), line_key)
    of_text = [F.xxhash64(text).alias("t1"), F.xxhash64(text, text).alias("t2")]
    lines = docs.filter(F.col(text).isNotNull()).select(*of_text, F.explode(F.array_distinct(keys)).alias("k")).filter("k <> ''").select("t1", "t2", F.xxhash64("k").alias("h1"), F.xxhash64("k", "k").alias("h2"))
    lines = lines.distinct().withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    parts = index.withColumn("parts", F.ceil(F.col("lines") / TASK_LINES).cast("int"))
    lines = lines.join(parts.select("shard", "parts"), "shard").withColumn("part", F.pmod(F.xxhash64("t1", "t2"), "parts").cast("int")).drop("parts")
    blobs = parts.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "index").withColumns({c: F.lit(0).cast("long") for c in ("t1", "t2", "h1", "h2")})
    dealt = lines.withColumn("index", F.lit(None).cast("binary")).unionByName(blobs).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("index").isNull())

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            cuts = [0, *np.flatnonzero(pdf["index"].notna().to_numpy()).tolist(), len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                part = pdf.iloc[a:b]
                if len(part) and part["index"].iloc[0] is not None:
                    now, part = pickle.loads(part["index"].iloc[0]), part.iloc[1:]
                if len(part) and now is not None:
                    h1, h2 = (part[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
                    yield part.loc[now.count(h1, h2) >= min_docs, ["t1", "t2", "h1", "h2"]].astype("int64")

    gone = dealt.select("t1", "t2", "h1", "h2", "index").mapInPandas(meet, "t1 long, t2 long, h1 long, h2 long")
    gone = gone.groupBy("t1", "t2").agg(F.collect_list(F.array("h1", "h2")).alias("gone"))

    @F.pandas_udf(_RESULT)
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        def one(t, g):
            away = set() if g is None else {(int(a) % 2**64, int(b) % 2**64) for a, b in g}
            test = lambda lines: np.array([bool(r) and (int(a), int(b)) in away for r, a, b in zip(*_hashes(lines))], bool)
            return _keep([t], test)

        return pd.concat([one(t, g) for t, g in zip(texts, gone)], ignore_index=True) if len(texts) else _keep([], lambda _: np.zeros(0, bool))

    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    joined = docs.withColumns({"t1": of_text[0], "t2": of_text[1], "salt": salt}).join(gone.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["t1", "t2", "salt"], "left")
    return joined.withColumn("lines", cut(F.col(text), F.col("gone"))).select(*docs.columns, "lines")


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs with frequent lines taken out of text, and the columns n_lines (before) and n_dropped.

    A line whose key (see line_key) is in at least min_docs rows of docs loses all its places in every row. Lines with
    an empty key stay. Null and empty texts are one empty line and become an empty text; a text all of whose lines go
    becomes empty and its row stays; a very long text is taken whole. Repeated rows count as rows of their own. Columns
    called n_lines or n_dropped are replaced; others, whatever their names, come back as they are. No rows give no rows.

    All distinct lines are in the index with their counts, and documents probe its arrays in place while the index fits
    broadcast_bytes: no text or line is shuffled then, but hashes for counting. Beyond, line hashes go to their shard, and
    the texts that have lines to drop are met by the hash of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = docs.select(own_columns(docs, text, "n_lines", "n_dropped"), F.col(text).alias("text"))
    index, shards = build_index(line_counts(work, "text"), shard_keys)
    size = index.agg(F.coalesce(F.sum(F.length("index")), F.lit(0))).first()[0]
    probe = _probe_all if size <= broadcast_bytes else _probe_shards
    out = probe(work, "text", index, shards, min_docs)
    names = [F.col("lines.text").alias(c) if c == text else F.col(f"own.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*names, "lines.n_lines", "lines.n_dropped")
