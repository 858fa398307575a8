"""Running values, as-of joins and sweeps over groups that are split, against plain Python; no task orders a whole group."""

import random
import time
from functools import reduce
from itertools import product
from operator import xor

import pytest
from pyspark.sql import functions as F

from tracelens.functions import costs
from tracelens.operators import edits as E
from tracelens.operators import scan, windows


def plain_running(rows, before):
    """rows (group, order, value): sum, greatest, last so far."""
    out = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))
        for i, r in enumerate(own):
            seen = [x[2] for x in (own[:i] if before else own[: i + 1]) if x[2] is not None]
            out.append((*r, sum(seen), max(seen, default=None), seen[-1] if seen else None, reduce(xor, seen, 0)))
    return sorted(out, key=str)


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("parts", [1, 3, 50])
def test_running(spark, before, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(-5, 9)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o long, v long, i long").repartition(5)
    v = F.col("v")
    got = scan.running(df, ["g"], ["o", "i"], {"s": v}, {"m": v}, {"l": v}, {"x": v}, before, parts)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_running(rows, before)
    cut = scan.running(df, ["g"], ["o", "i"], {"s": v}, {"m": v}, {"l": v}, {"x": v}, before, parts, cut_by=["o"])
    assert sorted((tuple(r) for r in cut.collect()), key=str) == plain_running(rows, before)
    assert scan.running(df.filter("i < 0"), ["g"], ["o", "i"], {"s": v}).collect() == []


def test_no_task_orders_a_group(spark):
    """One run has all rows: the windows' tasks have each a small part of them."""
    rows = spark.range(0, 40_000, 1, 6).select(F.floor(F.col("id") / 40_000).alias("run"), (F.col("id") * 7919 % 40_000).alias("at"), F.lit(1).alias("size"))
    out = scan.running(rows, ["run"], ["at"], {"upto": F.col("size")}, parts=16)
    assert out.filter("upto <> at + 1").count() == 0
    per_part = scan.ordered_parts(rows, ["run", "at"], "p", 16).groupBy("p").count().collect()
    assert len(per_part) == 17 and max(r["count"] for r in per_part) < 2.5 * 40_000 / 16
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(run#" in plan and "__part" in plan and "SinglePartition" not in plan
    for w in plan.split("\n"):
        assert "Window [" not in w or "__part" in w


def map_line(line, edits):
    if line < 1 or any(not ins and s <= line <= e for ins, s, e, *_ in edits):
        return None
    return line + sum(new - old for ins, s, e, new, old in edits if (line >= s if ins else line > e))


def some_edits(rng, n_lines, n):
    out, at = [], 1
    for _ in range(n):
        at += rng.randint(1, max(1, n_lines // n))
        if rng.random() < 0.3:
            out.append((True, at, at - 1, rng.randint(1, 3), 0))
        else:
            end = at + rng.randint(0, 2)
            out.append((False, at, end, rng.randint(0, 3), end - at + 1))
            at = end
    return out


def test_mapped_and_new_lines(spark):
    rng = random.Random(4)
    files = {f: some_edits(rng, 60, rng.randint(0, 12)) for f in range(12)} | {12: []}
    lines = [(f, n) for f in files for n in range(0, 70)] * 2
    edits = [(f, *e) for f, es in files.items() for e in es]
    ldf = spark.createDataFrame(lines, "file long, n long").repartition(3)
    edf = spark.createDataFrame(edits, "file long, insert boolean, start long, end long, new long, old long").repartition(3)
    got = sorted((tuple(r) for r in scan.mapped_lines(ldf, edf, "file", "n").collect()), key=str)
    assert got == sorted(((f, n, map_line(n, files[f])) for f, n in lines), key=str)

    def fresh(n, es):
        shift = 0
        for ins, s, e, new, old in es:
            if new and s + shift <= n < s + shift + new:
                return n >= 1
            shift += new - old
        return False

    got = sorted(tuple(r) for r in scan.new_lines(ldf, edf, "file", "n").collect())
    assert got == sorted((f, n, fresh(n, files[f])) for f, n in lines)


def test_arrays_and_joins_agree(spark):
    """The form for a few edits in one row and that for tables of edits."""
    rng = random.Random(6)
    es = some_edits(rng, 40, 6)
    own = spark.createDataFrame([(1, [tuple(e) for e in es])], "file long, e array<struct<insert:boolean,start:long,end:long,new:long,old:long>>")
    lines = own.select("file", "e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(50).cast("long"))).alias("n"))
    array = {r.n: (r.m, r.w) for r in lines.select("n", E.map_line(F.col("n"), F.col("e")).alias("m"), E.is_new_line(F.col("n"), F.col("e")).alias("w")).collect()}
    table = own.select("file", F.inline("e"))
    joined = {r.n: r.mapped for r in scan.mapped_lines(lines.select("file", "n"), table, "file", "n").collect()}
    new = {r.n: r.is_new for r in scan.new_lines(lines.select("file", "n"), table, "file", "n").collect()}
    assert array == {n: (joined[n], new[n]) for n in joined}


def test_long_file(spark):
    """A file of 10^6 lines and 10^5 edits, in one join: every tenth line is replaced by two."""
    start = time.time()
    lines = spark.range(1, 1_000_001, 1, 8).select(F.lit(1).cast("long").alias("file"), F.col("id").alias("n"))
    edits = spark.range(1, 100_001).select(F.lit(1).cast("long").alias("file"), F.lit(False).alias("insert"), (F.col("id") * 10).alias("start"), (F.col("id") * 10).alias("end"), F.lit(2).cast("long").alias("new"), F.lit(1).cast("long").alias("old"))
    out = scan.mapped_lines(lines, edits, "file", "n")
    want = F.when(F.col("n") % 10 != 0, F.col("n") + F.floor(F.col("n") / 10))
    assert out.filter(~F.col("mapped").eqNullSafe(want)).count() == 0 and out.filter("mapped is null").count() == 100_000
    assert time.time() - start < 120


def test_contained(spark):
    rng = random.Random(8)
    inner = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 99), i) for i in range(200)]
    outer = [(rng.choice([1, 1, 2, None]), p := rng.randint(0, 99), p + rng.randint(-1, 6)) for _ in range(40)]
    got = scan.contained(spark.createDataFrame(inner, "f long, pre long, i long"), spark.createDataFrame(outer, "f long, pre long, post long"), "f")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((r for r in inner if any(o[0] == r[0] and o[1] < r[1] <= o[2] for o in outer)), key=str)


def test_sweep_of_a_large_file(spark):
    """10^6 nodes of one file, each below one of the 10^5 outer nodes or not: a sweep, where a range join would try 10^11 pairs."""
    inner = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("f"), F.col("id").alias("pre"))
    outer = spark.range(0, 100_000).select(F.lit(1).alias("f"), (F.col("id") * 10).alias("pre"), (F.col("id") * 10 + 4).alias("post"))
    assert scan.contained(inner, outer, "f").count() == 400_000


def test_byte_cap_of_one_run(spark):
    chunks = spark.range(0, 5000, 1, 4).select(F.lit(1).alias("run"), F.col("id").alias("at"), F.lit(3).alias("size"))
    out = windows.byte_cap(chunks, "run", "at", "size", 1000).agg(F.sum("kept"), F.count_if("capped"), F.max("kept")).head()
    assert tuple(out) == (1000, 5000 - 333, 3)


def test_cost_sums(spark):
    """All sums of three classes, and longer ones, by the aggregate and by the fold over an array."""
    rows = [(i, k, c) for i, t in enumerate(product(costs.CLASSES, repeat=3)) for k, c in enumerate(t)]
    rng = random.Random(1)
    few = [c for c in costs.CLASSES if c != costs.UNKNOWN]
    rows += [(1000 + i, k, rng.choice(few)) for i in range(300) for k in range(rng.randint(1, 9))] + [(5000, k, costs.NM if k else costs.N2) for k in range(3)]
    df = spark.createDataFrame(rows, "g long, k long, c string").repartition(5)
    folded = df.groupBy("g").agg(costs.sum_aggregate(F.col("k"), F.col("c")).alias("total"))
    assert "collect_list" not in folded._jdf.queryExecution().toString() and "partial_min" in folded._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r.total for r in folded.collect()}
    groups = {}
    for g, _, c in rows:
        groups.setdefault(g, []).append(c)
    for g, cs in groups.items():
        total = costs.ONE
        for c in cs:
            total = costs.add(total, c)
        assert got[g] == total, cs
