"""Extension, not part of the reference's operators: suite summaries and peaks of runs that arrive as a stream.

State is one row for each window and group; the watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(runs: DataFrame, time: str, by: str, passed: str, duration: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, passes, greatest and mean duration of each window and group; rows later than ``late`` are dropped by the watermark."""
    return (
        runs.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr(passed)).alias("passed"), F.max(duration).alias("peak"), F.avg(duration).alias("mean"))
        .select(F.col("w.start").alias("start"), by, "total", "passed", "peak", "mean")
    )
