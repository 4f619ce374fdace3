"""Stored tables that are merged as they are read: batches of changes are appended, and single parts compacted now and then."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a new table, by hash of the key; a part is what a compaction rewrites.
PARTS = 64
#: A part is compacted once it has changes for this share of its rows, which is looked at every so many batches.
SHARE, EVERY = 0.25, 8
PART, GONE, BATCH, VERSION = "merge_part", "merge_gone", "merge_batch", "merge_version"


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, path)
    return fs.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def _numbers(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """The numbers of the folders name=number below path; those that were written to their end, or all."""
    fs, at = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.split("=")[1]) for n in names if "=" in n and (not whole or _exists(spark, f"{path}/{n}/_SUCCESS")))


def _settings(spark: SparkSession, path: str):
    """The row (keys, place, parts) of a table, or None where there is none yet."""
    return spark.read.parquet(f"{path}/settings").first() if _exists(spark, f"{path}/settings/_SUCCESS") else None


def _covered(spark: SparkSession, path: str) -> dict[int, tuple[int, int]]:
    """For each part that was compacted the version that it is in, and the last batch that this version has taken up."""
    whole = set(_numbers(spark, f"{path}/covered")) & set(_numbers(spark, f"{path}/base"))
    if not whole:
        return {}
    rows = spark.read.schema(f"part int, upto int, {VERSION} int").parquet(f"{path}/covered").filter(F.col(VERSION).isin(*whole))
    return {r["part"]: (r[VERSION], r["upto"]) for r in rows.orderBy(VERSION).collect()}  # a row a part and version


def _of_part(values: dict[int, int]) -> Column:
    """The value of a row's part, null for other parts."""
    if not values:
        return F.lit(None).cast("int")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(PART))


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(parts)).cast("int")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[f"`{k}`"]) for k in keys])


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by order, and of equal ones the greatest by its other columns that can be ordered, so that
    the result doesn't depend on how rows arrive. A null in a key is a value like any other."""
    rest = [F.desc(f"`{c}`") for c, t in rows.dtypes if c not in keys and "map<" not in t]
    ranked = rows.withColumn("merge_rank", F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order, *rest or [F.lit(1)])))
    return ranked.filter("merge_rank = 1").drop("merge_rank")


def _base_and_changes(spark: SparkSession, path: str, schema: str, parts: list[int] | None) -> tuple[DataFrame | None, DataFrame | None]:
    covered, batches = _covered(spark, path), _numbers(spark, f"{path}/changes")
    own = lambda df: df if parts is None else df.filter(F.col(PART).isin(*parts))
    base = changes = None
    if covered:
        base = own(spark.read.schema(f"{schema}, {VERSION} int, {PART} int").parquet(f"{path}/base").filter(F.col(VERSION) == _of_part({p: v for p, (v, _) in covered.items()})))
    if batches:
        live = F.col(BATCH).isin(*batches) & (F.col(BATCH) > F.coalesce(_of_part({p: u for p, (_, u) in covered.items()}), F.lit(0)))
        changes = own(spark.read.schema(f"{schema}, {PART} int, {GONE} boolean, {BATCH} int").parquet(f"{path}/changes").filter(live))
    return base, changes


def _merged(base: DataFrame | None, changes: DataFrame | None, keys: list[str], names: list[str]) -> DataFrame | None:
    names = [*names, PART]
    if changes is None:
        return None if base is None else base.select(*names)
    last = newest(changes, keys, F.desc(BATCH))
    out = last.filter(~F.col(GONE)).select(*names)
    if base is None:
        return out
    asked = last.select(*keys)
    return base.join(asked, same(base, asked, keys), "left_anti").select(*names).unionByName(out)


def read(spark: SparkSession, path: str, schema: str, parts: list[int] | None = None) -> DataFrame:
    """The rows of a table as of its last whole batch: for each key the newest of its changes, else the compacted row. Only the
    changes are ranked; compacted rows meet their keys in an anti-join, by broadcast as long as the changes are few. With parts,
    only these are read. A table that nothing was written to yet is empty."""
    told, fields = _settings(spark, path), StructType.fromDDL(schema)
    rows = _merged(*_base_and_changes(spark, path, schema, parts), told["keys"], fields.names) if told else None
    return spark.createDataFrame([], fields) if rows is None else rows.drop(PART)


def append(spark: SparkSession, path: str, new: DataFrame, schema: str, keys: list[str], order: str | None = None, gone: bool = False, place: list[str] | None = None, parts: int = PARTS) -> int:
    """Append a batch of changes: rows that are new or take the place of those of their key, or with gone that delete these.
    Returns the batch's number. What is written are the batch's own rows, whatever the size of the table.

    A batch counts once Spark has written it to its end; what a crash leaves behind is never read, and the same batch can be
    appended again. Of several rows of one key the last by order counts, see newest. place, some of the keys, says which rows share
    a part (all keys if not given); it, keys and parts are settled by the first batch. One writer at a time: a second one that
    takes the same number gets an error, and nothing is lost.
    """
    told = _settings(spark, path)
    if told is None:
        first = spark.createDataFrame([(keys, place or keys, parts)], "keys array<string>, place array<string>, parts int")
        first.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        told = first.first()
    elif list(told["keys"]) != keys:
        raise ValueError(f"the table's keys are {told['keys']}")
    names = StructType.fromDDL(schema).names
    rows = newest(new.select(*names), keys, *([F.desc(f"`{order}`")] if order else []))
    number = 1 + max(_numbers(spark, f"{path}/changes", whole=False), default=0)
    last = max([u for _, u in _covered(spark, path).values()], default=0)
    number = max(number, last + 1)  # batches that were taken up may have been deleted
    rows.withColumn(PART, part_of(told["place"], told["parts"])).withColumn(GONE, F.lit(gone)).write.parquet(f"{path}/changes/{BATCH}={number}")
    return number


def compact(spark: SparkSession, path: str, schema: str, share: float = SHARE) -> list[int]:
    """Rewrite the parts that have changes for at least that share of their rows, with the changes taken up, and return them; the
    other parts stay as they are. A compaction counts once the table of what it covers is written to its end, after its rows; until
    then the parts are read as before."""
    told = _settings(spark, path)
    if told is None:
        return []
    fields = StructType.fromDDL(schema)
    batches = _numbers(spark, f"{path}/changes")
    base, changes = _base_and_changes(spark, path, schema, None)
    if changes is None:
        return []
    rows = dict(base.groupBy(PART).count().collect()) if base is not None else {}
    due = sorted(p for p, n in changes.groupBy(PART).count().collect() if n >= share * rows.get(p, 0))  # a row a part
    if due:
        merged = _merged(*_base_and_changes(spark, path, schema, due), told["keys"], fields.names)
        version = 1 + max(_numbers(spark, f"{path}/base", whole=False) + _numbers(spark, f"{path}/covered", whole=False), default=0)
        merged.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{path}/base/{VERSION}={version}")
        spark.createDataFrame([(p, batches[-1]) for p in due], "part int, upto int").coalesce(1).write.parquet(f"{path}/covered/{VERSION}={version}")
    return due


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete what no reader needs any more: parts and versions that later ones have replaced, batches that all parts have taken
    up, and what was left unfinished. Not while another job reads or writes the table."""
    told, covered = _settings(spark, path), _covered(spark, path)
    if told is None:
        return
    current = {v for v, _ in covered.values()}
    for version in _numbers(spark, f"{path}/base", whole=False):
        if version not in current:
            _delete(spark, f"{path}/base/{VERSION}={version}")
        else:
            for part in _numbers(spark, f"{path}/base/{VERSION}={version}", whole=False):
                if covered.get(part, (0, 0))[0] != version:
                    _delete(spark, f"{path}/base/{VERSION}={version}/{PART}={part}")
    for version in _numbers(spark, f"{path}/covered", whole=False):
        if version not in current:
            _delete(spark, f"{path}/covered/{VERSION}={version}")
    used = set(_numbers(spark, f"{path}/changes"))
    taken = min((u for _, u in covered.values()), default=0) if len(covered) == told["parts"] else 0
    for batch in _numbers(spark, f"{path}/changes", whole=False):
        if batch <= taken or batch not in used:
            _delete(spark, f"{path}/changes/{BATCH}={batch}")


def clear(spark: SparkSession, path: str) -> bool:
    """Empty a table, which keeps its settings; false where there is none."""
    if not _exists(spark, f"{path}/settings/_SUCCESS"):
        return False
    for kind in ("changes", "covered", "base"):
        _delete(spark, f"{path}/{kind}")
    return True


def upsert(spark: SparkSession, path: str, new: DataFrame, schema: str, *keys: str, order: str | None = None, parts: int = PARTS) -> None:
    """new merged into the table by keys: one batch of changes, and every EVERY batches a compaction of the parts that are due."""
    if append(spark, path, new, schema, list(keys), order=order, parts=parts) % EVERY == 0:
        compact(spark, path, schema)
