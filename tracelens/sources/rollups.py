"""Summaries that are kept up to date: mergeable states of each day, added by increment, merged when they are asked for.

A state is what an aggregate needs of the rows it has seen: counts, sums, extremes, and sketches for distinct values and quantiles. States of
any parts of the rows merge to the state of all, so new rows are read once and old ones never again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import count_of, share
from ..session import hadoop_fs
from . import sinks


@dataclass(frozen=True)
class Measure:
    """An aggregate over rows, and the aggregate that merges its states."""

    make: Column
    merge: Callable[[str], Column]


#: Accuracy of the sketches: 2 ** LOG_K registers of distinct values (1.04 / sqrt(2 ** LOG_K) standard error); rank error of quantiles about 1.3 % at K.
LOG_K, K = 12, 200


def total(flag: Column | None = None) -> Measure:
    return Measure(F.count(F.lit(1)) if flag is None else count_of(flag), F.sum)


def distinct(value: Column) -> Measure:
    return Measure(F.hll_sketch_agg(value, LOG_K), F.hll_union_agg)


def quantiles(value: Column) -> Measure:
    return Measure(F.kll_sketch_agg_double(value.cast("double"), K), F.kll_merge_agg_double)


def suite_measures(passed: Column, valid: Column, duration: Column, peak: Column, who: Column) -> dict[str, Measure]:
    """What ``suite_summary`` needs of samples."""
    return {
        "total": total(), "passed": total(passed), "schema_valid": total(valid), "timed": total(duration.isNotNull()), "sum_ms": Measure(F.sum(duration), F.sum), "min_ms": Measure(F.min(duration), F.min),
        "max_ms": Measure(F.max(duration), F.max), "peak_bytes": Measure(F.max(peak), F.max), "times": quantiles(duration), "who": distinct(who),
    }


class Rollup:
    """States of ``measures`` by ``keys`` in a folder: one committed output for each increment, and a base that ``compact`` makes of them.

    An increment has a name; adding it again replaces it, so a repeated run counts nothing twice. The base's manifest names the increments that it
    holds: what it names is not read from elsewhere, so a compaction that fails between its steps loses and doubles nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], measures: dict[str, Measure]):
        self.spark, self.folder, self.keys, self.measures = spark, folder.rstrip("/"), list(keys), measures

    def names(self, of: str) -> list[str]:
        fs, path = hadoop_fs(self.spark, f"{self.folder}/{of}")
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in found if ".staged-" not in n)

    def add(self, name: str, rows: DataFrame) -> None:
        if name in self.held():
            raise ValueError(f"increment {name} is part of the base")
        states = rows.groupBy(*self.keys).agg(*[m.make.alias(k) for k, m in self.measures.items()])
        sinks.commit(states, f"{self.folder}/increments/{name}", "increment", format="parquet")

    def held(self) -> list[str]:
        """The increments that the base holds."""
        return sinks.read_manifest(self.spark, f"{self.folder}/base")["increments"] if "base" in self.names("") else []

    def states(self) -> DataFrame | None:
        """The states of the base and of all increments that it does not hold; several rows may have one key."""
        held = set(self.held())
        paths = [f"{self.folder}/increments/{n}" for n in self.names("increments") if n not in held] + ([f"{self.folder}/base"] if held else [])
        return self.spark.read.parquet(*paths) if paths else None

    def merged(self, by: Sequence[str] | None = None) -> DataFrame:
        """States by fewer keys, or by all: partial states merge before the shuffle."""
        return self.states().groupBy(*(self.keys if by is None else by)).agg(*[m.merge(k).alias(k) for k, m in self.measures.items()])

    def compact(self) -> None:
        """One row for each key, in a new base; increments that it holds go."""
        held = sorted({*self.held(), *self.names("increments")})
        if not held:
            return
        sinks.commit(self.merged(), f"{self.folder}/base", "base", format="parquet", facts={"increments": held})
        for name in self.names("increments"):
            if name in held:
                fs, path = hadoop_fs(self.spark, f"{self.folder}/increments/{name}")
                fs.delete(path, True)


def suite_summary(merged: DataFrame) -> DataFrame:
    """Merged ``suite_measures`` as figures: exact but for median_ms, whose rank is off by some hundredths at most, and n_who, which is off by a few hundredths of itself."""
    c = F.col
    kept = [k for k in merged.columns if k not in ("total", "passed", "schema_valid", "timed", "sum_ms", "min_ms", "max_ms", "peak_bytes", "times", "who")]
    return merged.select(
        *kept, "total", "passed", (c("total") - c("passed")).alias("failed"), "schema_valid", share(c("passed"), c("total")).alias("accuracy_pct"), share(c("schema_valid"), c("total")).alias("schema_valid_pct"),
        "min_ms", "max_ms", (c("sum_ms") / F.nullif("timed", F.lit(0))).alias("mean_ms"), F.when(c("timed") > 0, F.kll_sketch_get_quantile_double("times", F.lit(0.5))).alias("median_ms"),
        F.coalesce("peak_bytes", F.lit(0)).cast("long").alias("peak_bytes"), F.hll_sketch_estimate("who").alias("n_who"),
    )
