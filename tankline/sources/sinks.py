"""Writes: upsert, insert if absent, source registry, guards, CSV and JSON; stored tables are folders of Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .tables import newest, same

#: Bytes of a file that a row of one task may hold.
WHOLE_FILE = 256 << 20
# The stored tables, those that refer to others after them, as they are emptied.
CHILDREN_FIRST = (
    "track_measurement", "track_statistic", "sensor_statistic", "track", "manufacturer_average", "category_average", "vehicle_type_average", "register_average",
    "sensor", "register_car", "wiki_car", "country_price", "general_price", "country", "phenomenon",
)


def upserted(old: DataFrame, new: DataFrame, *keys: str, order: str | None = None) -> DataFrame:
    """The rows of both, of one key that of new, and of several in new the last by order (of equal ones, and without an order,
    the greatest by its other columns, so that the result doesn't depend on how rows arrive). A null in a key is a value like
    any other. Columns that one side lacks are null. A row of old is only met by its key, so a large table with few changes
    is one shuffle of each side."""
    last = newest(new, list(keys), *([F.desc(order)] if order else []))
    return old.join(last.select(*keys), same(old, last, list(keys)), "left_anti").unionByName(last, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The rows of new whose key isn't in old, each key once (its greatest row by the other columns): what an insert would add. A
    null in a key is a value like any other, so inserting the same rows again adds nothing."""
    first, known = newest(new, list(keys)), old.select(*keys).distinct()
    return first.join(known, same(first, known, list(keys)), "left_anti")


def updated_matches(cars: DataFrame, matches: DataFrame) -> DataFrame:
    """Register cars with the match arrays of matches (hash_id, wiki_hashes) where there are any; all else stays."""
    new = matches.select("hash_id", F.col("wiki_hashes").alias("_new")).dropDuplicates(["hash_id"])
    return cars.join(new, "hash_id", "left").withColumn("wiki_hashes", F.coalesce("_new", "wiki_hashes")).select(*cars.columns)


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """(object_hash, object_name, bytes): the SHA-1 of each file at path. Files of up to whole bytes are read and hashed by tasks, a
    file a row. Larger ones, which a row can't hold, are few: their names are listed, and each is streamed from its store a block at
    a time, so that no more than a block of it is in memory. Spark lists no empty files, so these have no row."""
    listed = spark.read.format("binaryFile").load(path)
    small = listed.filter(F.col("length") <= whole).select(F.sha1("content").alias("object_hash"), F.col("path").alias("object_name"), F.col("length").alias("bytes"))
    jvm, conf, rows = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for r in listed.filter(F.col("length") > whole).select("path", "length").collect():
        at = jvm.org.apache.hadoop.fs.Path(r["path"])
        stream = at.getFileSystem(conf).open(at)
        try:
            rows.append((jvm.org.apache.commons.codec.digest.DigestUtils.sha1Hex(stream), r["path"], r["length"]))
        finally:
            stream.close()
    return small.unionByName(spark.createDataFrame(rows, "object_hash string, object_name string, bytes long"))


def changed_sources(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """(object_hash, object_name) of the files at path whose content the registry (object_hash) doesn't know, of any size."""
    files = file_hashes(spark, path).select("object_hash", "object_name")
    return files.join(registry.select("object_hash"), "object_hash", "left_anti")


def floats_only(df: DataFrame, *columns: str) -> DataFrame:
    """Measures that aren't numbers become null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def blanks_as_zero(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, see tables.read; one that nothing was written to yet is empty."""
    return tables.read(spark, path, schema)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, schema: str, *keys: str, order: str | None = None, parts: int = tables.PARTS) -> None:
    """new merged into the table at path by keys, of several rows of one key the last by order. What is written follows new, not
    the table, and a merge that is lost midway leaves the table as it was: run it again. See tables."""
    tables.upsert(spark, path, new, schema, *keys, order=order, parts=parts)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset and Spark runs in this process alone, below the local
    temporary folder. On a cluster it must be set, as executors and driver share no other."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root or tempfile.gettempdir()}/spark-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is then used."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def truncate(spark: SparkSession, path: str) -> None:
    """Empty the table at path, which stays a table."""
    if not tables.clear(spark, path):
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def truncate_all(spark: SparkSession, root: str, tables: tuple[str, ...] = CHILDREN_FIRST) -> list[str]:
    """Empty the tables below root, those that refer to others first; returns the names of those that were there."""
    done = []
    for name in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            truncate(spark, f"{root.rstrip('/')}/{name}")
            done.append(name)
    return done


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json_documents(df: DataFrame, path: str) -> None:
    """One document a line, fields in alphabetical order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)
