"""Runs that arrive as a stream of samples: a run ends when it has been silent for a while.

Samples of one key come in any order, within a batch and across batches, as long as they are not later than the watermark allows. Runs are Spark's session
windows: the state of a key is its open runs, each an interval of time with what is known of it, and the watermark closes them. The batch form gives the same rows of
the same samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State beyond an executor's heap; session windows take any store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings for a stream of very many runs, or of a run with very many samples: its samples become one row in each task before the shuffle.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def merged(runs: list[tuple], gap_ms: int) -> list[tuple]:
    """Runs (first, last, n, peak, total), sorted, of which those become one that are at most ``gap_ms`` apart: the rule that both forms follow, in plain Python."""
    out: list[tuple] = []
    for run in sorted(runs, key=lambda r: r[:2]):
        if out and run[0] - out[-1][1] <= gap_ms:
            a = out.pop()
            peaks = [x for x in (a[3], run[3]) if x is not None]
            run = (a[0], max(a[1], run[1]), a[2] + run[2], max(peaks, default=None), a[4] + run[4])
        out.append(run)
    return out


def of_a_run() -> list[Column]:
    """First and last sample (milliseconds), number of samples, greatest value and total size."""
    return [F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")]


def ended_runs(samples: DataFrame, run: str, time: str, value: str, size: str, gap_ms: int, late: str = "10 minutes") -> DataFrame:
    """A stream of runs (run, first_ms, last_ms, n, peak, total) that have ended, from a stream of samples. Samples without a time are in no run.

    Times count in whole milliseconds, and samples ``gap_ms`` apart are in one run, so the session's gap is half a millisecond longer: a run ends when the watermark,
    ``late`` behind the latest sample, is more than ``gap_ms`` behind its last. Samples that lie so far behind it themselves are dropped.
    """
    rows = samples.filter(F.col(time).isNotNull()).withColumn(time, F.timestamp_millis(F.unix_millis(time))).withWatermark(time, late)
    rows = rows.select(F.col(run).alias("run"), time, F.unix_millis(time).alias("ms"), F.col(value).cast("double").alias("value"), F.col(size).cast("long").alias("size"))
    silence = F.session_window(time, f"{gap_ms} milliseconds 500 microseconds")
    return rows.groupBy("run", silence).agg(*of_a_run()).drop("session_window")


def runs_of(samples: DataFrame, run: str, time: str, value: str, size: str, gap_ms: int) -> DataFrame:
    """All runs of a table of samples, ended or not, with the same columns."""
    rows = samples.filter(F.col(time).isNotNull()).select(F.col(run).alias("run"), F.unix_millis(time).alias("ms"), F.col(value).cast("double").alias("value"), F.col(size).cast("long").alias("size"))
    order = Window.partitionBy("run").orderBy("ms")
    begins = F.coalesce(F.col("ms") - F.lag("ms").over(order) > gap_ms, F.lit(True))
    numbered = rows.withColumn("begins", begins.cast("long")).withColumn("number", F.sum("begins").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("run", "number").agg(*of_a_run()).drop("number")
