"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: The characters [\x20\x09-\x0D], all that counts as white space here.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key that has at least this share of all rows is joined by broadcast; by arithmetic there are at most 1 / HOT_SHARE.
HOT_SHARE = 1 / 2000
COMPONENT_ROUNDS = 60
#: Spark's setting that shuffle files go with the execution that wrote them.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a text that are cut into words at once.
WORD_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset and Spark runs on this
    machine alone, as in tests, a new local folder serves; on a cluster that is an error, as executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = os.environ.setdefault("TANKLINE_SHARED", tempfile.mkdtemp(prefix="spark-shared-"))
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, *partitions: str, release: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again, which cuts its lineage. With release, what the write has
    shuffled is deleted once it is done, as the table is read in its place."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.partitionBy(*partitions).parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if own is None else spark.conf.set(RELEASE, own)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A table that materialize wrote, read anew, so that it can meet itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._written_to)


def discard(df: DataFrame, partition: str = "") -> None:
    """Delete a table that materialize wrote, or a partition of it, that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{df._written_to}/{partition}".rstrip("/"))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Send the code to the executors, and bound what one Arrow batch holds where the session leaves that open: texts can
    be long, and a Python worker holds a few batches. Spark reads these settings when a query starts, after the operator
    has returned, so they stay set; a session's own values are respected."""
    ship(spark)
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 8 << 20)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def give_memory_back() -> None:
    """Return what a Python worker has freed to the system, as it lives on beside the executor's JVM and others of its kind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def byte_words(text: bytes, keep_breaks: bool = False) -> Iterator[list[bytes]]:
    """The words of a text, runs without white space, a portion of it at a time. With keep_breaks only blanks part words, so that
    a line break between blanks is one."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + WORD_BYTES)
        end = len(text) if end < 0 else end
        yield [w for w in text[at:end].split(b" ") if w] if keep_breaks else text[at:end].split()
        at = end


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def own_columns(df: DataFrame, *replaced: str):
    """The columns of df but for those that are replaced, as one struct: whatever their names, they can't clash with those
    that an operator works with. F.col("own.*") gives them back."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in replaced]
    return F.struct(*kept or [F.lit(None).cast("string").alias("nothing")]).alias("own")


def give_back(df: DataFrame, *columns) -> DataFrame:
    """The columns of the struct own, and then columns."""
    names = [f.name for f in df.schema["own"].dataType.fields]
    return df.select(*[F.col(f"own.`{n}`") for n in names if names != ["nothing"]], *columns)


def hot_join(rows: DataFrame, groups: DataFrame, key: str | list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups, which has each key once, and in weight how many of the total rows have it.
    Keys with a large share of all rows are few and meet their rows by broadcast, so that no task gets all of them; the rest
    are joined by shuffle. rows is read twice: a table, not a computation."""
    least = max(1.0, total * HOT_SHARE)
    hot, rest = groups.filter(F.col(weight) >= least), groups.filter(F.col(weight) < least)
    other = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(other)


def components(edges: DataFrame, max_rounds: int = COMPONENT_ROUNDS) -> DataFrame:
    """Connected components of (u, v) links, as (node, root): root is the least node reachable.

    Alternates large-star and small-star steps, each a groupBy(min) and an equi-join, until no link changes. A
    node's links are never gathered in one row; nodes with a large share of all links meet theirs by broadcast; the state
    of each round is written to the shared folder, and the one before it deleted. Null ends and self-links are ignored;
    without links the result is empty. The rounds grow with the logarithm of the longest path; if max_rounds don't do, it
    is an error, never a partial result.
    """
    links = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialize(links, "links")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(both, least, "u", "n", 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "u", "n", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, links = links, materialize(small.filter("u <> v").distinct(), "links")
        discard(last)
        discard(large)
        now = state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
