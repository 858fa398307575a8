"""Ends of runs to the millisecond, and that a stream of them runs no Python."""

from datetime import datetime, timedelta, timezone

import pytest

from tracelens.streaming import runs

KIND = "run long, ts timestamp, rss double, bytes long"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
AT = int(START.timestamp() * 1000)


@pytest.fixture
def settings(spark):
    old = {key: spark.conf.get(key, None) for key in runs.SETTINGS}
    for key, value in runs.SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_no_python(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "in"))
    out = runs.ended_runs(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), "run", "ts", "rss", "bytes", 1000)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "Python" not in plan and "InPandas" not in plan


def test_ends_to_the_millisecond(settings, tmp_path):
    """Samples a gap apart join, whatever their microseconds; a run ends only when the watermark is more than a gap behind it."""
    us = lambda n: START + timedelta(microseconds=n)
    rows = [(1, us(0), 1.0, 1), (1, us(1_000_999), 2.0, None), (1, us(2_002_000), None, 5), (None, us(10), None, None), (None, us(1_000_000), float("nan"), 2)]
    rows += [(2, us(7_000_000), 1.0, 1), (3, us(6_999_999), 1.0, 1), (4, None, 1.0, 1), (5, us(13_000_000), 0.0, 0)]
    settings.createDataFrame(rows, KIND).repartition(3).write.parquet(str(tmp_path / "in"))
    source = settings.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    out = runs.ended_runs(source, "run", "ts", "rss", "bytes", 1000, "5 seconds")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(tuple(r)) for r in settings.read.parquet(str(tmp_path / "out")).collect()))
    want = [(1, AT, AT + 1000, 2, 2.0, 1), (1, AT + 2002, AT + 2002, 1, None, 5), (None, AT, AT + 1000, 2, float("nan"), 2), (3, AT + 6999, AT + 6999, 1, 1.0, 1)]
    assert got == sorted(map(str, want))
