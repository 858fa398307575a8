"""Pairing of findings in Spark against plain passes over whole files, and on one line with all findings."""

import random

import pytest
from pyspark.sql import functions as F

from tracelens.operators import matching, pairing

KIND = "id long, file long, code string, line long, col long, message string"
NAMES = ("id", "file", "code", "line", "col", "message")


def pair_findings(baseline: list[dict], candidate: list[dict]) -> list[tuple]:
    """(baseline_id, candidate_id, outcome) of one file's findings, in their order.

    A finding is (id, code, line, col, message); line of a baseline finding is where it stands now, None if edited. Within a (code, line), baseline
    findings choose in turn, first for equal column and message, then for either, then for any; the earliest candidate that is left wins.
    """
    pools: dict[tuple, list[dict]] = {}
    for c in candidate:
        pools.setdefault((c["code"], c["line"]), []).append(c)
    fits = (
        lambda b, c: b["col"] == c["col"] and b["message"] == c["message"],
        lambda b, c: b["col"] == c["col"] or b["message"] == c["message"],
        lambda b, c: True,
    )
    open_ = [b for b in baseline if b["line"] is not None]
    out = [(b["id"], None, "eliminated") for b in baseline if b["line"] is None]
    for fit in fits:
        left = []
        for b in open_:
            pool = pools.get((b["code"], b["line"]), [])
            at = next((i for i, c in enumerate(pool) if fit(b, c)), None)
            if at is None:
                left.append(b)
            else:
                out.append((b["id"], pool.pop(at)["id"], "pre_existing"))
        open_ = left
    out += [(b["id"], None, "eliminated") for b in open_]
    return out + [(None, c["id"], "introduced") for pool in pools.values() for c in pool]


def check(spark, b, c):
    got = sorted(map(tuple, pairing.diff_pairs(spark.createDataFrame(b, KIND).repartition(3), spark.createDataFrame(c, KIND).repartition(2)).collect()), key=str)
    of = lambda rows, f: [dict(zip(NAMES, r)) for r in sorted(rows) if r[1] == f]
    assert got == sorted(((f, *x) for f in {r[1] for r in b + c} for x in pair_findings(of(b, f), of(c, f))), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_files(spark, seed):
    """Few and many columns and messages, null ones too, lines on one side alone, ids in any order."""
    rng = random.Random(seed)
    cols, texts = [[1, 2], [1, 2, 3, None], list(range(40)), [1]][seed], [["x", "y"], ["x", None, "z"], ["m"], [str(i) for i in range(30)]][seed]
    make = lambda first, lines, n: [(first + i, rng.choice([1, 2, 3]), rng.choice("AB"), rng.choice(lines), rng.choice(cols), rng.choice(texts)) for i in rng.sample(range(n * 2), n)]
    check(spark, make(0, [1, 2, 5, None], 160), make(1000, [1, 2, 7], 130))


def test_one_side(spark):
    check(spark, [(1, 1, "A", 1, 1, "x"), (2, 1, "A", None, 1, "x")], [])
    check(spark, [], [(1, 1, "A", 1, 1, "x"), (2, 1, "A", 1, 1, "x")])


def test_one_line_of_100000_findings(spark):
    """A minified file: all findings of one code on one line. Equal ones, then those of one message whose columns moved."""
    base = spark.range(0, 100_000, 1, 8).select("id", F.lit(1).cast("long").alias("file"), F.lit("E").alias("code"), F.lit(1).cast("long").alias("line"), F.col("id").alias("col"), F.lit("m").alias("message"))
    moved = base.withColumn("col", F.when(F.col("id") < 50_000, F.col("col")).otherwise(F.col("col") + 200_000)).filter("id % 10 <> 3 or id < 50000").withColumn("id", F.col("id") + 1_000_000)
    out = pairing.diff_pairs(base, moved)
    counts = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert counts == {"pre_existing": 95_000, "eliminated": 5_000}
    assert out.filter("baseline_id < 50000 and candidate_id <> baseline_id + 1000000").count() == 0
    tail = out.filter("baseline_id >= 50000").orderBy("baseline_id").select("baseline_id", "candidate_id").collect()
    want = [1_000_000 + i for i in range(50_000, 100_000) if i % 10 != 3]
    assert [r.candidate_id for r in tail] == want + [None] * 5000


def test_one_tangled_line(spark):
    """40,000 findings of a line with few columns and messages of their own: in time, and as plain passes over counts tell."""
    rng = random.Random(7)
    b = [(i, 1, "E", 1, rng.randint(0, 99), f"m{rng.randint(0, 99)}") for i in range(20_000)]
    c = [(10**6 + i, 1, "E", 1, rng.randint(0, 99), f"m{rng.randint(0, 99)}") for i in range(20_000)]
    out = pairing.diff_pairs(spark.createDataFrame(b, KIND), spark.createDataFrame(c, KIND))
    assert {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()} == {"pre_existing": 20_000}
    assert out.select("candidate_id").distinct().count() == out.select("baseline_id").distinct().count() == 20_000
    n = matching.diff_counts(spark.createDataFrame(b, KIND), spark.createDataFrame(c, KIND), ["file", "code", "line"]).head()
    assert (n.pre_existing, n.eliminated, n.introduced) == (20_000, 0, 0)
