"""Committed outputs: all or nothing, with counts from the write itself; documents of bounded size."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracelens.sources import files, generator, sinks


def rows(spark, n=1000):
    return spark.range(0, n, 1, 5).select("id", F.when(F.col("id") % 10 == 0, "val").when(F.col("id") % 10 == 1, "test").otherwise("train").alias("split"), F.when(F.col("id") % 3 == 0, F.lit("x")).alias("note"))


def test_counts_come_from_the_write(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    data = rows(spark).mapInArrow(seen, "id long, split string, note string")
    made = sinks.write_splits(data, out)
    assert reads.value == 1000 and (made["total_samples"], made["train"], made["val"], made["test"]) == (1000, 800, 100, 100)
    assert sinks.read_manifest(spark, out) == made and {r["split"]: r["count"] for r in spark.read.json(out).groupBy("split").count().collect()} == {"train": 800, "val": 100, "test": 100}
    line = json.loads(open(next(f"{d}/{f}" for d, _, fs in os.walk(tmp_path / "out" / "split=train") for f in fs if f.endswith(".json"))).readline())
    assert set(line) == {"id", "note"}  # null fields are written


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bad = rows(spark).withColumn("note", F.when(F.col("id") == 990, F.raise_error(F.lit("boom"))).otherwise("x"))
    with pytest.raises(PySparkException, match="boom"):
        sinks.write_splits(bad, out)
    assert os.listdir(tmp_path) == []
    sinks.write_splits(rows(spark, 50), out)
    with pytest.raises(PySparkException, match="boom"):
        sinks.write_splits(bad, out)
    assert os.listdir(tmp_path) == ["out"] and sinks.read_manifest(spark, out)["total_samples"] == spark.read.json(out).count() == 50
    sinks.write_splits(rows(spark, 70), out)
    assert os.listdir(tmp_path) == ["out"] and sinks.read_manifest(spark, out)["total_samples"] == spark.read.json(out).count() == 70
    sinks.write_splits(rows(spark, 0), out)
    assert sinks.read_manifest(spark, out)["total_samples"] == sinks.read_manifest(spark, out)["train"] == 0


def test_manifest_samples(spark, tmp_path):
    listing = spark.createDataFrame([("a.py", 3), ("b.py", 4)], "path string, n_rows long")
    entries = spark.createDataFrame([("1", "a.py", None), ("2", "b.py", "O(n)")], "id string, path string, expected_time string")
    out = f"file://{tmp_path}/m"
    assert sinks.commit(generator.manifest_samples(listing, entries), out, "suite")["total_samples"] == 2
    assert sorted(map(tuple, files.json_lines(spark, out, "path string, id string, expected_time string, row_count long").collect())) == [("a.py", "1", None, 3), ("b.py", "2", "O(n)", 4)]
    with pytest.raises(PySparkException, match="missing file: c.py"):
        sinks.commit(generator.manifest_samples(listing, entries.union(spark.createDataFrame([("3", "c.py", None)], entries.schema))), out, "suite")
    assert sinks.read_manifest(spark, out)["total_samples"] == 2


def test_documents_are_bounded(spark, tmp_path):
    data = spark.range(0, 400, 1, 4).select("id", (F.col("id") % 4 == 9).cast("string").alias("g"), F.repeat(F.lit("y"), 1000).alias("text"))
    made = files.json_documents(data, "g", "id", F.struct("id", "text"), F.lit("d").alias("dataset"), "samples", most_bytes=20_000)
    sizes = [len(r.value) for r in made.collect()]
    assert 20 <= len(sizes) <= 22 and max(sizes) < 22_000
    made.write.option("maxRecordsPerFile", 1).text(str(tmp_path / "d"))
    back = files.json_items(spark, str(tmp_path / "d"), "struct<id:long,text:string>", "samples")
    assert sorted(r.id for r in back.collect()) == list(range(400))
    each = [[s["id"] for s in json.loads(r.value)["samples"]] for r in made.collect()]
    assert all(ids == list(range(ids[0], ids[0] + len(ids))) for ids in each)
