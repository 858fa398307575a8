"""Medians: exact for any groups, in as many scans for three as for one."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tracelens.operators import stats


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
def test_medians(spark, by):
    rng = random.Random(len(by))
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice("xy"), rng.choice([None, rng.random(), 0.5, 0.5, -1.0]), rng.randint(0, 3)) for _ in range(3000)] + [(7, "x", None, 4), (8, "y", 2.0, None)]
    df = spark.createDataFrame(rows, "g long, h string, v double, n long").repartition(5)
    got = stats.grouped(df, by, [F.count(F.lit(1)).alias("rows")], {"mv": F.col("v"), "mn": F.col("n"), "neg": -F.col("v")})
    assert got.columns == [*by, "rows", "mv", "mn", "neg"]
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r["gh".index(b)] for b in by), []).append(r)
    middle = lambda xs: statistics.median(map(float, xs)) if xs else None
    want = [(*k, len(rs), middle([r[2] for r in rs if r[2] is not None]), middle([r[3] for r in rs if r[3] is not None]), middle([-r[2] for r in rs if r[2] is not None])) for k, rs in groups.items()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "g long, v double")
    assert stats.grouped(df, ["g"], [F.count("v").alias("n")], {"m": F.col("v")}).collect() == []
    assert [tuple(r) for r in stats.grouped(df, [], [F.count("v").alias("n")], {"m": F.col("v")}).collect()] == [(0, None)]


def test_scans_do_not_grow(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3).alias("g"), F.rand(1).alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def plan(n):
        out = stats.grouped(df, ["g"], [F.count("v").alias("n")], {f"m{i}": F.col("v") * (i + 1) for i in range(n)})
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in text
        return len(re.findall("FileScan", text)), len(re.findall(r"Exchange ", text))

    assert plan(1)[0] == plan(3)[0] == plan(6)[0] == 3 and plan(3) == plan(6) and plan(1)[1] <= plan(3)[1]


def test_large_group_with_few_values_at_the_middle(spark):
    """A third of the rows have the middle value; of the others all differ."""
    df = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, F.col("id") + 0.5).otherwise(-F.col("id").cast("double")).alias("v"))
    assert stats.grouped(df, [], [], {"m": F.col("v"), "w": F.col("v") * 2}).head() == (0.0, 0.0)
    spread = spark.range(0, 100_001, 1, 8).select((F.col("id") * 7919 % 100_001).cast("double").alias("v"))
    assert stats.grouped(spread, [], [], {"m": F.col("v")}).head()[0] == 50_000.0
