"""Runs of a stream against the batch form: samples in any order, late ones, several batches, a restart, a key with very many samples."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracelens.streaming import runs

GAP = 60_000
KIND = "run long, ts timestamp, rss double, bytes long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, runs.PROVIDER)
    yield spark
    spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def samples(n, seed):
    """Samples of some minutes, by time, then shuffled within a few minutes."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), START + timedelta(seconds=rng.randint(0, 5000) * rng.choice([1, 1, 3])), rng.choice([None, rng.random()]), rng.choice([None, rng.randint(0, 9)])) for _ in range(n)]
    return sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 200)))


def feed(spark, folder, parts, late="5 minutes"):
    """Each part is a batch of its own; the stream is stopped and started again after each."""
    (folder / "in").mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        out = runs.ended_runs(source, "run", "ts", "rss", "bytes", GAP, late)
        out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(str(folder / "out")).collect()), key=str)


def test_equal_to_the_batch(rocks, tmp_path):
    rows = samples(900, 1)
    got = feed(rocks, tmp_path, [rows[i : i + 150] for i in range(0, 900, 150)])
    table = rocks.createDataFrame(rows, KIND)
    end = int(max(r[1] for r in rows).timestamp() * 1000) - 300_000
    whole = sorted((tuple(r) for r in runs.runs_of(table, "run", "ts", "rss", "bytes", GAP).select("run", "first_ms", "last_ms", "n", "peak", "total").collect()), key=str)
    assert got == [r for r in whole if r[2] + GAP < end] and len(got) > 30 and len(got) < len(whole)


def test_batch_form(spark):
    rng = random.Random(2)
    rows = samples(400, 2) + [(1, None, 1.0, 1)]
    got = sorted(map(tuple, runs.runs_of(spark.createDataFrame(rows, KIND).repartition(3), "run", "ts", "rss", "bytes", GAP).select("run", "first_ms", "last_ms", "n", "peak", "total").collect()), key=str)
    want = []
    for k in {r[0] for r in rows}:
        own = [(int(t.timestamp() * 1000), int(t.timestamp() * 1000), 1, v, s or 0) for r, t, v, s in rows if r == k and t]
        rng.shuffle(own)
        want += [(k, *r) for r in runs.merged(own, GAP)]
    assert got == sorted(want, key=str)


def test_late_samples_are_dropped(rocks, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    first = [(1, at(0), 1.0, 5), (1, at(0.5), 3.0, None), (2, at(60), 1.0, 1)]
    got = feed(rocks, tmp_path, [first, [(1, at(1), 9.0, 9), (2, at(60.5), None, 2)], [(2, at(90), 1.0, 1)]])
    ms = lambda m: int(at(m).timestamp() * 1000)
    assert got == [(1, ms(0), ms(0.5), 2, 3.0, 5), (2, ms(60), ms(60.5), 2, 1.0, 3)]


def test_one_key_with_many_samples(rocks, tmp_path):
    n = 20_000
    rows = [(1, START + timedelta(seconds=(i * 7919) % n), float(i), 1) for i in range(n)]
    assert feed(rocks, tmp_path, [rows, [(2, START + timedelta(days=1), 0.0, 0)], [(3, START + timedelta(days=2), 0.0, 0)]])[0][3:] == (n, n - 1.0, n)
