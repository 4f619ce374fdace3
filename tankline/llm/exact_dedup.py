"""Exact dedup with DataFrame functions only: 128-bit content hash, then a byte comparison inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hot_join, materialize

#: Hashes of repeated texts that are broadcast to find these texts (some 60 MB); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _bare(text: str):
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: (key, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are the same bytes after every white space character is deleted; null counts as empty,
    and so do texts of white space alone, which form one group. Of equal texts the one with the most code points
    stays, then the least key; a null key comes last. One row stays, also where rows repeat a key or are the same in
    all: each row counts, and of rows with one key and length any one is kept. Very long texts are hashed and compared whole. Other columns of docs are not read. No rows give no rows.

    Rows are grouped by MD5, merged in each task before the shuffle, however large a group is. Only texts whose hash comes
    up again are then read once more, and grouped by their bytes: two texts with one hash are two groups, which their
    SHA-256 tells apart. Copies meet their group by hot_join, so that no task gets all copies of one text.
    """
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("id"), length.alias("n"), _bare(text).alias("bare")).withColumn("hash", F.unhex(F.md5("bare")))
    members = materialize(rows.select("id", "n", "hash", F.unhex(F.sha2("bare", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "content-hashes")
    again = materialize(members.groupBy("hash").agg(F.count("*").alias("rows")).filter("rows > 1").select("hash"), "repeated-hashes")
    suspects = rows.join(F.broadcast(again) if again.count() <= broadcast_rows else again, "hash", "left_semi")
    groups = suspects.groupBy("hash", "bare").agg(F.count("*").alias("size")).filter("size > 1")
    groups = materialize(groups.select(F.concat("hash", F.unhex(F.sha2("bare", 256))).alias("pair"), "size"), "copies")
    copies = groups.agg(F.sum("size")).first()[0] or 0
    named = members.select("id", "n", "row", "sha", F.concat("hash", "sha").alias("pair"))
    best = F.min(F.struct(-F.col("n"), F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("row"))).alias("best")
    stays = hot_join(named, groups, "pair", "size", copies).groupBy("pair", "size").agg(best)
    stays = materialize(stays.select("pair", "size", F.lit(True).alias("copied"), F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row")), "stays")
    judged = hot_join(named, stays, "pair", "size", copies, how="left")
    keep = F.when(F.col("copied"), F.col("keep")).otherwise(F.col("id"))
    kept = F.when(F.col("copied"), F.col("row") == F.col("keep_row")).otherwise(F.lit(True))
    return judged.select(
        F.col("id").alias(key), keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
