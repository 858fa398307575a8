"""Merged states against one pass over all rows; increments that are repeated, compactions that stop halfway."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracelens.sources import rollups, sinks

KIND = "suite string, day int, ok boolean, valid boolean, ms double, peak long, who long"


def data(n=6000):
    rng = random.Random(3)
    return [(rng.choice(["a", "a", "b", None]), rng.randint(1, 5), rng.random() < 0.7, rng.choice([True, False, None]), rng.choice([None, rng.expovariate(1)]), rng.choice([None, rng.randint(0, 99)]), rng.randint(0, 900)) for _ in range(n)] + [("z", 1, None, None, None, None, None)]


def rollup(spark, folder):
    return rollups.Rollup(spark, f"file://{folder}", ["suite", "day"], rollups.suite_measures(F.col("ok"), F.col("valid"), F.col("ms"), F.col("peak"), F.col("who")))


def check(rows, got):
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        own = [x for x in rows if x[0] == r.suite]
        ms = sorted(x[4] for x in own if x[4] is not None)
        n, ok, valid = len(own), sum(bool(x[2]) for x in own), sum(bool(x[3]) for x in own)
        assert (r.total, r.passed, r.failed, r.schema_valid, r.accuracy_pct) == (n, ok, n - ok, valid, pytest.approx(100 * ok / n))
        assert (r.min_ms, r.max_ms, r.peak_bytes) == (min(ms, default=None), max(ms, default=None), max((x[5] for x in own if x[5] is not None), default=0))
        if not ms:
            assert r.mean_ms is None and r.median_ms is None and r.n_who == 0
            continue
        assert r.mean_ms == pytest.approx(statistics.mean(ms))
        assert abs(sum(x <= r.median_ms for x in ms) / len(ms) - 0.5) < 0.03
        who = len({x[6] for x in own})
        assert abs(r.n_who - who) <= 0.06 * who


def test_increments_and_compaction(spark, tmp_path):
    rows, r = data(), rollup(spark, tmp_path / "r")
    frame = lambda part: spark.createDataFrame(part, KIND).repartition(3)
    for i in range(3):
        r.add(f"i{i}", frame(rows[i::3]))
    r.add("i1", frame(rows[1::3]))  # a repeated run
    summary = lambda: rollups.suite_summary(r.merged(["suite"])).collect()
    check(rows, summary())
    r.compact()
    check(rows, summary())
    assert r.names("increments") == [] and r.states().count() == len({x[:2] for x in rows})
    with pytest.raises(ValueError, match="part of the base"):
        r.add("i0", frame(rows[:5]))
    more = data(500)
    r.add("i3", frame(more))
    check(rows + more, summary())
    by_day = r.merged(["day"]).select("day", "total").collect()
    assert {x.day: x.total for x in by_day} == {d: sum(x[1] == d for x in rows + more) for d in range(1, 6)}
    r.compact()
    r.compact()
    check(rows + more, summary())


def test_compaction_that_stops_before_it_removes(spark, tmp_path):
    """The base is there and so are the increments that it holds: they count once."""
    rows, r = data(900), rollup(spark, tmp_path / "r")
    for i in range(2):
        r.add(f"i{i}", spark.createDataFrame(rows[i::2], KIND))
    sinks.commit(r.merged(), f"{r.folder}/base", "base", format="parquet", facts={"increments": ["i0", "i1"]})
    check(rows, rollups.suite_summary(r.merged(["suite"])).collect())
    r.compact()
    check(rows, rollups.suite_summary(r.merged(["suite"])).collect())


def test_partial_states_merge_before_the_shuffle(spark, tmp_path):
    r = rollup(spark, tmp_path / "r")
    r.add("i", spark.createDataFrame(data(50), KIND))
    assert "partial_hll_union_agg" in (plan := r.merged(["suite"])._jdf.queryExecution().executedPlan().toString()) and "partial_kll_merge_agg" in plan
