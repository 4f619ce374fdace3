"""Incremental loads with Structured Streaming: measurements, sensors, prices and running statistics."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.prices import not_yet_stored
from ..sources import tables
from ..sources.readers import FEATURES, track_features
from ..sources.sinks import changed_sources, kept, upsert_table
from ..sources.tables import newest, same

STATE = "sensor_id string, phenomenon string, max double, sum double, min double, n long"
VALUES = "track_measurement_id string, track_id string, sensor_id string, phenomenon string, phenomenon_value double, date timestamp"
COUNTS = "sensor_id string, phenomenon string, phenomenon_value double, n long, load long"
#: The partitions that values are stored in, the load that brought them and their day; values without a date have one of their own.
LOAD, DAY = "load", "day"
SENSORS = "sensor_id string, sensor_type string, manufacturer_raw string, car_model string, fuel_raw string, construction_year int"


def measurement_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The measurements of new page files, as they land, one row for each value."""
    pages = spark.readStream.schema(FEATURES).option("multiLine", True).json(folder)
    return track_features(pages)[1]


def append(values: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each (track_measurement_id, phenomenon) of all there is now that isn't stored yet, appended to Parquet by load and day; run
    again for what has come since. The keys that were met are Spark's state, a store on disk that is kept in the checkpoint, so a
    batch reads no stored rows, and old tracks that are brought in late are met like new ones: no row is too late. A null in a key
    is a value like any other. A batch that is run again after a failure replaces what it had written, as its load has its
    number. Rows of another run, after a lost checkpoint, say, are not in the state: only where there are such loads their keys are
    read again, of all days. A measurement has one value of a phenomenon; of rows that differ in it the first to arrive
    counts."""
    keys, run = ["track_measurement_id", "phenomenon"], hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    met = values.withColumn(DAY, F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("none"))).dropDuplicates(keys)

    def add(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, batch
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        loads = [x.getPath().getName().partition("=")[2] for x in fs.listStatus(at)] if fs.exists(at) else []
        others = [x for x in loads if x and not x.startswith(f"{run}-")]
        if others:
            stored = spark.read.schema(f"{VALUES}, {LOAD} string, {DAY} string").parquet(out).filter(F.col(LOAD).isin(*others)).select(*keys)
            new = new.join(stored, same(new, stored, keys), "left_anti")  # of any day, as rows of one key may have several
        new.withColumn(LOAD, F.lit(f"{run}-{number}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LOAD, DAY).parquet(out)

    writer = met.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    spark, provider = values.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()
    finally:
        spark.conf.set(provider, own)


def upsert_stream(rows: DataFrame, path: str, schema: str, keys: tuple[str, ...], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Each batch merged into the table at path by keys, which writes what the batch has, not the table; a batch that is run twice
    after a failure changes nothing, as the same rows of it win. What wins inside a batch is stated by order."""
    def merge(batch: DataFrame, _: int) -> None:
        upsert_table(batch.sparkSession, path, batch, schema, *keys, order=order)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_statistics(values: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Max, sum, min and count by sensor and phenomenon, kept up with what arrives: Spark keeps the aggregates as its state,
    and each batch merges those that changed into the table at path, so a batch that is run again doesn't count twice."""
    v = F.col("phenomenon_value")
    sums = values.groupBy("sensor_id", "phenomenon").agg(F.max(v).alias("max"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.count(v).alias("n"))

    def merge(batch: DataFrame, _: int) -> None:
        upsert_table(batch.sparkSession, path, batch, STATE, "sensor_id", "phenomenon")

    return sums.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corrected_statistics(changes: DataFrame, values: str, counts: str, stats: str, checkpoint: str) -> StreamingQuery:
    """Statistics that follow corrections: changes are measurements (VALUES) with changed, which orders those of one key, and deleted.
    A change takes the place of the measurement with its (track_measurement_id, phenomenon) in the table values, or deletes it.

    Max and min can't be taken back, so the state is how often each value occurs, the table counts by sensor, phenomenon and value;
    its parts are by sensor and phenomenon, so a batch reads and ranks only the parts of what it touches. A batch is turned into
    differences of these counts, which are stored under its number before anything else is, and a count remembers the last load
    that changed it; so a batch that is run again after a failure at any step counts once. The table stats (STATE) gets the
    statistics of what the batch touched, and loses those that no measurement is left of."""
    keys, group = ["track_measurement_id", "phenomenon"], ["sensor_id", "phenomenon"]
    value = [*group, "phenomenon_value"]

    def apply(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{counts}-differences/{LOAD}={number}"
        rows = kept(newest(batch, keys, F.desc("changed")), "changes")
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            asked, stored = rows.select(*keys), tables.read(spark, values, VALUES)
            old = stored.join(asked, same(stored, asked, keys), "left_semi").select(*value, F.lit(-1).alias("d"))
            signed = old.unionByName(rows.filter("not deleted").select(*value, F.lit(1).alias("d"))).filter("phenomenon_value is not null")
            signed.groupBy(*value).agg(F.sum("d").alias("d")).filter("d <> 0").write.mode("overwrite").parquet(folder)
        differences = spark.read.schema("sensor_id string, phenomenon string, phenomenon_value double, d long").parquet(folder)
        tables.append(spark, values, rows.filter("not deleted"), VALUES, keys)
        tables.append(spark, values, rows.filter("deleted"), VALUES, keys, gone=True)

        parts = [r[0] for r in differences.select(tables.part_of(group, tables.PARTS)).distinct().collect()]  # at most PARTS
        if not parts:
            return
        known = tables.read(spark, counts, COUNTS, parts)
        before = known.select(*[F.col(c).alias(f"old_{c}") for c in value], F.col("n").alias("old_n"), F.col(LOAD).alias("old_load"))
        met = [differences[c].eqNullSafe(before[f"old_{c}"]) for c in value]
        now = differences.join(before, met[0] & met[1] & met[2], "left").filter(F.coalesce(F.col("old_load") < number, F.lit(True)))
        now = now.select(*value, (F.coalesce("old_n", F.lit(0)) + F.col("d")).alias("n"), F.lit(number).cast("long").alias(LOAD))
        tables.append(spark, counts, now, COUNTS, value, place=group)
        touched, left = differences.select(*group).distinct(), tables.read(spark, counts, COUNTS, parts).filter("n > 0")
        v, n = F.col("phenomenon_value"), F.col("n")
        left = left.join(touched, same(left, touched, group), "left_semi").groupBy(*group).agg(F.max(v).alias("max"), F.sum(v * n).alias("sum"), F.min(v).alias("min"), F.sum(n).alias("n"))
        left = kept(left, "statistics")
        gone = touched.join(left, same(touched, left, group), "left_anti")
        tables.append(spark, stats, left, STATE, group)
        tables.append(spark, stats, gone.select(*group, *[F.lit(None).cast(t).alias(c) for c, t in (("max", "double"), ("sum", "double"), ("min", "double"), ("n", "long"))]), STATE, group, gone=True)
        if number % tables.EVERY == tables.EVERY - 1:
            for path, schema in ((values, VALUES), (counts, COUNTS), (stats, STATE)):
                tables.compact(spark, path, schema)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_prices(spark: SparkSession, path: str, registry: DataFrame, prices: DataFrame, stored: DataFrame) -> DataFrame:
    """The price rows that aren't stored yet, if the source's content isn't known yet; else none."""
    changed = changed_sources(spark, path, registry).limit(1).select(F.lit(1).alias("_one"))
    return not_yet_stored(prices, stored, "country", "date").join(F.broadcast(changed), F.lit(True), "left_semi")
