"""Stored tables that are merged on read: crashes, replays, deletes, and what a batch writes."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tankline.operators import prices
from tankline.sources import sinks, tables
from tankline.streaming import ingest

SCHEMA = "k int, v string, n int"


def rows_of(spark, path):
    return sorted((tuple(r) for r in tables.read(spark, path, SCHEMA).collect()), key=str)


def data_files(path):
    return {f: f.stat().st_size for f in Path(path).rglob("part-*.parquet")}


def test_batches_deletes_and_compactions_equal_a_dictionary(spark, tmp_path):
    draw, path, known = random.Random(1), str(tmp_path / "t"), {}
    assert rows_of(spark, path) == [] and tables.compact(spark, path, SCHEMA) == [] and tables.vacuum(spark, path) is None
    for step in range(7):
        keys = [draw.choice([None, *range(25)]) for _ in range(12)]
        gone = step in (2, 5)
        batch = [(k, f"{step}-{i}", i) for i, k in enumerate(keys)]
        tables.append(spark, path, spark.createDataFrame(batch, SCHEMA), SCHEMA, ["k"], order="n", gone=gone, parts=5)
        for k, v, n in batch:
            known.pop(k, None) if gone else known.update({k: (k, v, n)})
        expected = sorted(known.values(), key=str)
        assert rows_of(spark, path) == expected
        if step in (1, 3, 6):
            assert tables.compact(spark, path, SCHEMA, share=0.5 if step == 3 else 0.0)
            assert rows_of(spark, path) == expected
            if step != 1:
                before = len(data_files(path))
                tables.vacuum(spark, path)
                assert rows_of(spark, path) == expected and len(data_files(path)) < before
    with pytest.raises(ValueError):
        tables.append(spark, path, spark.createDataFrame(batch, SCHEMA), SCHEMA, ["v"])
    tables.append(spark, path, spark.createDataFrame([(k, None, None) for k in [None, *range(25)]], SCHEMA), SCHEMA, ["k"], gone=True)
    tables.compact(spark, path, SCHEMA, share=0)
    tables.vacuum(spark, path)
    assert rows_of(spark, path) == []
    tables.append(spark, path, spark.createDataFrame([(1, "again", 1)], SCHEMA), SCHEMA, ["k"])
    assert rows_of(spark, path) == [(1, "again", 1)]
    sinks.truncate(spark, path)
    assert rows_of(spark, path) == []


def crash(folder, half):
    """What a job that is killed leaves: no mark of success, and some or none of its files."""
    (folder / "_SUCCESS").unlink()
    files = sorted(data_files(folder))
    for f in files[: len(files) if half == "none" else len(files) // 2]:
        f.unlink()


@pytest.mark.parametrize("half", ["none", "half", "all"])
def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, half):
    path, keep = tmp_path / "t", {"none": "none", "half": "half", "all": "all"}[half]
    base = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"), F.lit(0).alias("n"))
    tables.append(spark, str(path), base, SCHEMA, ["k"], parts=4)
    whole = rows_of(spark, str(path))
    change = base.filter("k % 10 = 0").withColumn("v", F.lit("b"))
    changed = sorted(((k, "b" if k % 10 == 0 else "a", 0) for k in range(1000)), key=str)
    break_ = lambda folder: (folder / "_SUCCESS").unlink() if keep == "all" else crash(folder, keep)

    tables.append(spark, str(path), change.repartition(3), SCHEMA, ["k"])  # the batch is half written
    break_(path / "changes/merge_batch=2")
    assert rows_of(spark, str(path)) == whole
    tables.append(spark, str(path), change, SCHEMA, ["k"])
    assert rows_of(spark, str(path)) == changed
    assert tables.compact(spark, str(path), SCHEMA) == [0, 1, 2, 3]  # the compaction is lost before or while it says what it covers
    break_(path / "covered/merge_version=1")
    assert rows_of(spark, str(path)) == changed
    assert tables.compact(spark, str(path), SCHEMA) == [0, 1, 2, 3]
    break_(path / "base/merge_version=2")
    assert rows_of(spark, str(path)) == changed
    assert tables.compact(spark, str(path), SCHEMA) == [0, 1, 2, 3] and rows_of(spark, str(path)) == changed
    tables.vacuum(spark, str(path))
    assert rows_of(spark, str(path)) == changed and not (path / "base/merge_version=1").exists() and not (path / "changes/merge_batch=2").exists()


def test_a_batch_writes_its_own_rows_and_a_compaction_single_parts(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v long"
    tables.append(spark, path, spark.range(200_000).select(F.col("id").alias("k"), F.col("id").alias("v")), schema, ["k"])
    assert len(tables.compact(spark, path, schema)) == tables.PARTS
    before = data_files(path)
    sinks.upsert_table(spark, path, spark.range(100).select((F.col("id") * 1999).alias("k"), F.lit(-1).cast("long").alias("v")), schema, "k")
    after = data_files(path)
    new = [f for f in after if f not in before]
    assert all(after[f] == size for f, size in before.items()) and sum(spark.read.parquet(str(f)).count() for f in new) == 100
    assert tables.compact(spark, path, schema) == []  # no part has changes for a quarter of its rows
    plan = tables.read(spark, path, schema)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and tables.read(spark, path, schema).filter("v = -1").count() == 100
    part = tables.part_of(["k"], tables.PARTS)
    hot = spark.range(200_000).select(F.col("id").alias("k"), F.lit(5).cast("long").alias("v")).filter(part == 7)
    n = hot.count()
    tables.append(spark, path, hot, schema, ["k"])
    assert tables.compact(spark, path, schema) == [7]
    rewritten = [f for f in data_files(path) if f not in after and "base" in str(f)]
    assert {f.parent.name for f in rewritten} == {"merge_part=7"} and tables.read(spark, path, schema, parts=[7]).count() == n
    assert tables.read(spark, path, schema).count() == 200_000


def test_null_keys_are_inserted_once(spark):
    new = spark.createDataFrame([(None, 1, "x"), (None, 1, "y"), (2, 1, "z")], "a int, b int, c string")
    assert sorted((tuple(r) for r in sinks.inserted(new.limit(0), new, "a", "b").collect()), key=str) == [(2, 1, "z"), (None, 1, "y")]
    assert sinks.inserted(new, new, "a", "b").count() == 0 and prices.not_yet_stored(new, new, "a", "b").count() == 0


VALUES = "track_measurement_id string, track_id string, sensor_id string, phenomenon string, phenomenon_value double, date timestamp"


def test_measurements_are_stored_once_without_reading_what_is_stored(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, VALUES.replace("date timestamp", "day string")).selectExpr("* except (day)", "to_timestamp(day) as date").write.mode("append").parquet(source)
    run = lambda mark: ingest.append(spark.readStream.schema(VALUES).parquet(source), out, str(tmp_path / mark)).awaitTermination()
    stored = lambda: sorted((r.track_measurement_id or "", r.phenomenon or "", str(r.day)) for r in spark.read.parquet(out).collect())
    put([("p1", "t", "s", "Speed", 1.0, "2024-01-01"), (None, "t", "s", "Speed", 2.0, None), (None, "t", "s", None, 3.0, "2024-01-02")])
    run("a")
    first = stored()
    assert len(first) == 3
    put([("p1", "t", "s", "Speed", 1.0, "2024-01-01"), (None, "t", "s", "Speed", 2.0, None), ("p2", "t", "s", "Speed", 4.0, "2019-05-05")])
    real, read = type(spark.read).parquet, []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *a, **k: (read.append(a), real(self, *a, **k))[1])
    run("a")
    assert not read  # the state knows the keys
    monkeypatch.undo()
    assert len(stored()) == 4 and ("p2", "Speed", "2019-05-05") in stored()
    once = stored()
    commits = sorted((tmp_path / "a/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()  # as if the run had died after its last batch was written
    for crc in (tmp_path / "a/commits").glob(".*.crc"):
        crc.unlink()
    run("a")
    assert stored() == once
    run("b")  # the checkpoint is lost, and all is read once more
    assert stored() == once


def test_a_measurement_of_another_day_is_stored_once_after_a_lost_checkpoint(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("p1", "t", "s", "Speed", 1.0, "2024-01-01"), (None, "t", "s", "Speed", 2.0, "2024-01-01"), ("p2", "t", "s", "Speed", 3.0, "2024-01-01")]
    later = [("p1", "t", "s", "Speed", 1.0, "2024-01-05"), (None, "t", "s", "Speed", 2.0, None), ("p3", "t", "s", "Speed", 3.0, "2024-01-05")]
    for mark, part in (("a", rows), ("b", later)):
        spark.createDataFrame(part, VALUES.replace("date timestamp", "day string")).selectExpr("* except (day)", "to_timestamp(day) as date").write.parquet(str(tmp_path / f"in-{mark}"))
        ingest.append(spark.readStream.schema(VALUES).parquet(str(tmp_path / f"in-{mark}")), out, str(tmp_path / mark)).awaitTermination()
    assert sorted((r.track_measurement_id or "", str(r.day)) for r in spark.read.parquet(out).collect()) == [("", "2024-01-01"), ("p1", "2024-01-01"), ("p2", "2024-01-01"), ("p3", "2024-01-05")]


def test_statistics_follow_corrections_and_deletions(spark, tmp_path):
    draw, known = random.Random(5), {}
    path = {n: str(tmp_path / n) for n in ("in", "values", "counts", "stats", "mark")}
    schema = f"{VALUES}, changed int, deleted boolean"
    go = lambda: ingest.corrected_statistics(spark.readStream.schema(schema).parquet(path["in"]), path["values"], path["counts"], path["stats"], path["mark"]).awaitTermination()

    def check():
        groups = {}
        for s, p, v in known.values():
            if v is not None:
                groups.setdefault((s, p), []).append(v)
        expected = sorted((s, p, max(v), sum(v), min(v), len(v)) for (s, p), v in groups.items())
        got = sorted((r.sensor_id, r.phenomenon, r.max, r.sum, r.min, r.n) for r in tables.read(spark, path["stats"], ingest.STATE).collect())
        assert got == expected and tables.read(spark, path["values"], ingest.VALUES).count() == len(known)

    at = 0
    for step in range(3):
        rows = []
        for _ in range(30):
            at += 1
            key, gone = (f"m{draw.randrange(20)}", draw.choice(["Speed", "CO2"])), step > 0 and draw.random() < 0.4
            value = draw.choice([None, 1.0, 2.0, 5.0, 9.0])
            sensor = draw.choice(["a", "b", "c"])
            rows.append((key[0], "t", sensor, key[1], value, None, at, gone))
            known.pop(key, None) if gone else known.update({key: (sensor, key[1], value)})
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path["in"])
        go()
        check()
    commits = sorted((tmp_path / "mark/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()  # the last batch is run again
    for crc in (tmp_path / "mark/commits").glob(".*.crc"):
        crc.unlink()
    go()
    check()
