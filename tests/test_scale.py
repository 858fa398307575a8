"""Operators that deal hot groups out, against plain Python: ties, nulls, outliers, one group for all."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.operators import matching, stats, windows
from tracelens.plans import catalogue


def draws(rng, n):
    sort = rng.randrange(4)
    return [rng.choice([None, 1.0, 1.0, 2.0]) if sort == 0 else rng.random() ** 9 * 1e9 if sort == 1 else float(rng.randrange(50)) if sort == 2 else (1e300 if rng.random() < 0.01 else rng.gauss(0, 1)) for _ in range(n)]


def test_medians(spark):
    rng = random.Random(1)
    rows = [(g, "x" if g % 2 else None, v) for g, n in enumerate((1, 2, 3, 10, 999, 1000, 20_001, 30_000)) for v in draws(rng, n)] + [(50, None, None)] + [(None, "x", 4.0), (None, "x", 8.0)]
    df = spark.createDataFrame(rows, "g int, h string, v double").repartition(5)
    for by in (["g"], ["g", "h"], ["h"], []):
        want = {}
        for g, h, v in rows:
            want.setdefault(tuple({"g": g, "h": h}[b] for b in by), []).append(v)
        found = stats.grouped(df, by, [F.count(F.lit(1)).alias("n"), F.max("v").alias("most")], {"median": F.col("v"), "twice": F.col("v") * 2})
        got = {tuple(r[: len(by)]): tuple(r[len(by) :]) for r in found.collect()}
        assert found.columns == [*by, "n", "most", "median", "twice"] and set(got) == set(want)
        for k, vs in want.items():
            some = [v for v in vs if v is not None]
            median = statistics.median(some) if some else None
            assert got[k][:2] == (len(vs), max(some, default=None))
            assert got[k][2] == (pytest.approx(median) if some else None) and got[k][3] == (pytest.approx(2 * median) if some else None)


def test_no_exact_percentile_is_planned(spark):
    for name in ("a01_suite_summary", "a02_scorecard", "a05_timing_stats", "a06_heap_stats", "a07_token_stats", "w09_median", "s10_manifest"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile_approx(" in plan and " percentile(" not in plan, name


@pytest.mark.parametrize("keys", [
    [None, 5, 3, 3, None, 1], list(range(1000)), [0] * 300 + [10**12] + list(range(50)) + [None] * 40, [None] * 5, [], [7], [7] * 20, [-1.5, 2.25, 1e18, -1e18, 0.0],
])
def test_positions(spark, keys):
    rows = list(enumerate(float(k) if k is not None else None for k in keys))
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "i long, k double").repartition(3)
    got = sorted((r["__pos"], r["k"]) for r in windows.positions(df, "k", ranges=8, parts=4).collect())
    assert [p for p, _ in got] == list(range(len(keys)))
    assert [k for _, k in got] == sorted((k for _, k in rows), key=lambda k: (k is not None, k or 0))
    assert windows.stride(df, "k", 3).count() == -(-len(keys) // 3)


def test_spans_in_bins(spark):
    rng = random.Random(3)
    spans = [(i, rng.choice("ab"), a := rng.randint(-70, 700), a + rng.choice([0, 1, 5, 63, 64, 300, -3])) for i in range(150)]
    points = [(i, rng.choice("abc"), rng.choice([rng.randint(-80, 900), None])) for i in range(200)]
    s, p = spark.createDataFrame(spans, "ordinal long, file string, start long, end long"), spark.createDataFrame(points, "id long, file string, at long")
    got = {r.id: r.span.ordinal if r.span else None for r in matching.innermost(p, s, "file", "at", "start", "end", "id", "ordinal").collect()}
    assert got == {i: min(((e - a, o) for o, f, a, e in spans if f == file and at is not None and a <= at <= e), default=(0, None))[1] for i, file, at in points}
    pairs = sorted((r.ordinal, r.ordinal_) for r in matching.overlapping(s, s, "file").collect())
    assert pairs == sorted((x[0], y[0]) for x in spans for y in spans if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2] and x[3] >= x[2] and y[3] >= y[2])


def test_reassembled_lines(spark):
    rows = [(["a", "b"], "\r\n", True, True), (["a", None, "c"], "\n", False, False), ([], "\n", True, False), (["x"] * 100_000, "mixed", True, False)]
    df = spark.createDataFrame(rows, "l array<string>, s string, t boolean, b boolean")
    got = [r[0] for r in df.select(T.reassemble(F.col("l"), "s", F.col("t"), F.col("b"))).collect()]
    assert got == ["﻿a\r\nb\r\n", "a\n\nc", "", "x\n" * 100_000]
