"""Ordered operators: splits, samples, caps, running shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import range_count, running


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``split`` (train, val or test): of n rows in a stratum, round-half-even(n / 10) but 1 at least go to each of val and test from 10
    rows on, 1 each from 3, none below; the order within a stratum is that of a seeded hash of the key.

    Ranks come from ``ranked``, so no task sorts a stratum whole.
    """
    placed = ranked(rows, [stratum], [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)])
    n = F.col("__n")
    held = F.when(n >= 10, F.greatest(F.lit(1), F.bround(n * 0.1))).when(n >= 3, 1).otherwise(0).cast("long")
    train = F.greatest(F.lit(1), n - 2 * held)
    split = F.when(F.col("__rank") <= train, "train").when(F.col("__rank") <= train + held, "val").otherwise("test")
    return placed.withColumn("split", split).drop("__rank", "__n")


def ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds __rank (from 1, by ``order`` within the group) and __n (rows of the group).

    A group may hold a third of all rows, so no task sorts a group whole: rows are dealt to buckets by the first three characters of the first
    order column's text (4096 of a digest in hexadecimal), ranked within (group, bucket), and shifted by the counts of the buckets before, a
    table of at most as many rows a group.
    """
    bucket = F.substring(order[0].cast("string"), 1, 3)
    dealt = rows.withColumn("__bucket", F.coalesce(bucket, F.lit("")))
    counts = dealt.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__own"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__own").over(w.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__bucket").alias("__b"), before.alias("__before"), F.sum("__own").over(w).alias("__n"))
    within = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order))
    same = F.col("__bucket") == F.col("__b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = dealt.withColumn("__within", within).join(offsets, same)
    return out.withColumn("__rank", F.col("__within") + F.col("__before")).drop("__within", "__before", "__bucket", "__b", *[f"__k{i}" for i in range(len(by))])


def first_per_group(rows: DataFrame, by: list[str], order: list[str], k: int = 2) -> DataFrame:
    """The first k rows of each group; Spark keeps k a group in each task before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__at", at).filter(F.col("__at") <= k).drop("__at")


def stride(rows: DataFrame, order: str, step: int) -> DataFrame:
    """Every step-th row by order (nulls first), from the first: position by counts of ranges, not by one global sort."""
    return positions(rows, order).filter(F.col("__pos") % step == 0).drop("__pos")


def range_number(x: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds are at most x, by halving."""
    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    return within(0, len(bounds))


def positions(rows: DataFrame, order: str, ranges: int = 128, parts: int = 64) -> DataFrame:
    """Adds __pos, the place (from 0) of each row by a numeric key, nulls first; rows of one key are in any order.

    Quantiles of the key (a sketch, ``ranges`` numbers on the driver) part the rows into ranges of about equal size, whatever outliers there are, and each
    range is parted evenly again; counts of the parts give each part's offset, so only rows of one part meet in a task. Rows of a key that is a bound
    itself, as one is that holds many rows, and rows without a key are dealt out by a hash.
    """
    probs = [i / ranges for i in range(ranges + 1)]
    found = rows.agg(F.percentile_approx(order, F.array(*map(F.lit, probs)), F.lit(10_000))).head()[0]
    bounds = sorted(set(found or []))
    key = F.col(order)
    at = F.when(key.isNotNull(), range_number(key, bounds))
    lows, highs = F.array(*[F.lit(x) for x in (bounds[:1] or [0]) + bounds]), F.array(*[F.lit(x) for x in (bounds or [0]) + (bounds[-1:] or [0])])
    low, high = F.get(lows, F.col("__i")), F.get(highs, F.col("__i"))
    any_part = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(parts)).cast("int")
    even = F.least(F.greatest(F.floor((key - low) / F.greatest((high - low).cast("double"), F.lit(1e-300)) * parts), F.lit(0)), F.lit(parts - 1)).cast("int")
    equal = key == low
    dealt = rows.withColumn("__i", F.coalesce(at, F.lit(-1)).cast("int"))
    dealt = dealt.withColumn("__r", F.struct(F.col("__i").alias("range"), F.when(key.isNull() | equal, 0).otherwise(1).alias("above"), F.when(key.isNull() | equal, any_part).otherwise(even).alias("part"))).drop("__i")
    counts = dealt.groupBy("__r").agg(F.count(F.lit(1)).alias("__own"))
    before = counts.select(F.col("__r").alias("__s"), F.coalesce(F.sum("__own").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__r").orderBy(order)) - 1
    return dealt.withColumn("__w", within).join(before, F.col("__r") == F.col("__s")).withColumn("__pos", F.col("__w") + F.col("__before")).drop("__r", "__s", "__w", "__before")


def byte_cap(chunks: DataFrame, run: str, order: str, size: str, cap: int) -> DataFrame:
    """Bytes kept of each chunk under the run's cap, and whether the cap is reached by then; a chunk after it keeps none. A run of any length is summed in ranges."""
    out = running(chunks, [run], [order], sums={"__upto": F.col(size)})
    left = F.greatest(F.lit(cap) - (F.col("__upto") - F.col(size)), F.lit(0))
    return out.withColumn("kept", F.least(F.col(size), left)).withColumn("capped", F.col("__upto") >= cap).drop("__upto")


def drained(chunks: DataFrame, size: str, most: int = 4096, together: int = 4096) -> DataFrame:
    """Reads of a pipe of at most ``most`` bytes each: a row for each read of each chunk, with its number (from 0) and bytes. Empty chunks are no reads.

    Reads are as many as the bytes ask for, however few the chunks. Chunks are dealt out whole, but those with more than a sixteenth of a task's even share of all reads
    in parts of that many: neither a chunk of any size nor a region of the table with large ones is drained by one task, and what is shuffled is at most a row for each
    chunk and sixteenth. Behind the shuffle reads are unfolded in stretches of ``together``, and no list of them is longer.
    """
    tasks = 4 * range_count(chunks)
    own = chunks.filter(F.col(size) > 0)
    last = F.expr(f"(`{size}` - 1) div {most * together}")  # stretch
    stretches = own.agg(F.sum(last + 1)).first()[0] or 0
    part = max(1, -(-stretches // (16 * tasks)))
    upto = F.expr(f"(`{size}` - 1) div {most * together * part}")
    dealt = own.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), upto))).repartition(tasks)
    at = F.col("__part") * part
    unfolded = dealt.withColumn("__stretch", F.explode(F.sequence(at, F.least(at + (part - 1), last)))).drop("__part")
    first = F.col("__stretch") * together
    rows = unfolded.withColumn("read", F.explode(F.sequence(first, F.least(first + (together - 1), F.expr(f"(`{size}` - 1) div {most}"))))).drop("__stretch")
    return rows.withColumn("n_bytes", F.least(F.lit(most).cast("long"), F.col(size) - F.col("read") * most))


def measured(invocations: DataFrame, by: list[str], order: str, warmup: int) -> DataFrame:
    """Recorded invocations without the first ``warmup`` of each target; a target with no more than those has none."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return invocations.withColumn("__at", at).filter(F.col("__at") > warmup).drop("__at")


def stopped_runs(chunks: DataFrame, run: str, order: str, elapsed: str, size: str, cap: int, limit: Column) -> DataFrame:
    """Why each run ended: (run, stored, truncated, timed_out). Its chunks count in order until the cap is reached, which stops it, or until one comes at or after
    ``limit`` seconds, which stops it as timed out; a cap that is reached by the same chunk comes first."""
    rows = running(chunks, [run], [order], sums={"__upto": F.col(size)}, greatest={"__late": F.col(elapsed) >= limit}).withColumn("__full", F.col("__upto") >= cap)
    at = lambda flag: F.min(F.when(F.col(flag), F.col(order)))
    found = rows.groupBy(run).agg(at("__full").alias("__f"), at("__late").alias("__l"), F.max("__upto").alias("__all"), F.max(F.when(~F.col("__late"), F.col("__upto"))).alias("__before"))
    full = F.col("__f").isNotNull() & (F.col("__l").isNull() | (F.col("__f") <= F.col("__l")))
    late = F.col("__l").isNotNull() & ~full
    stored = F.when(full, F.lit(cap)).when(late, F.least(F.coalesce("__before", F.lit(0)), F.lit(cap))).otherwise(F.col("__all"))
    return found.select(run, stored.cast("long").alias("stored"), full.alias("truncated"), late.alias("timed_out"))


def out_of_order(edits: DataFrame, proposal: str, ordinal: str, start: str, end: str) -> DataFrame:
    """Adds ``violates``: whether an edit starts at or before the previous one's start or end."""
    w = Window.partitionBy(proposal).orderBy(ordinal)
    bad = (F.col(start) <= F.lag(start).over(w)) | (F.col(start) <= F.lag(end).over(w))
    return edits.withColumn("violates", F.coalesce(bad, F.lit(False)))


def running_shift(edits: DataFrame, proposal: str, order: list[str], delta: Column) -> DataFrame:
    """Adds ``shift``: sum of the deltas of the edits before, whatever their number."""
    return running(edits, [proposal], order, sums={"shift": delta.cast("long")}, before=True)


def excerpt(start: Column, end: Column, fault: Column, total: Column, around: int = 15, first: int = 30) -> Column:
    """Struct (start, end) of the lines to show: the enclosing function, else the lines around the fault, else the first lines."""
    one = F.lit(1)
    return F.struct(
        F.when(start.isNotNull(), start).when(fault.isNotNull(), F.greatest(one, fault - around)).otherwise(one).cast("long").alias("start"),
        F.least(total, F.when(start.isNotNull(), end).when(fault.isNotNull(), fault + around).otherwise(F.lit(first))).cast("long").alias("end"),
    )


def shrink(start: Column, end: Column, center: Column, total: Column, rounds: int = 24) -> Column:
    """Array of ever narrower (start, end) windows around a center: each side halves but keeps 3 lines; ends at a window of 6 lines or one that no
    longer changes. The first element is the window itself."""
    def narrower(w: Column) -> Column:
        return F.struct(
            F.greatest(F.lit(1).cast("long"), center - F.greatest(F.lit(3), F.floor((center - w["start"]) / 2))).cast("long").alias("start"),
            F.least(total, center + F.greatest(F.lit(3), F.floor((w["end"] - center) / 2))).cast("long").alias("end"),
        )

    def step(a: Column, _: Column) -> Column:
        last = F.element_at(a, -1)
        new = narrower(last)
        return F.when((last["end"] - last["start"] > 6) & (new != last), F.concat(a, F.array(new))).otherwise(a)

    begin = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step)


def ordinal_id(prefix: str, ordinal: Column) -> Column:
    """``prefix_00001`` of ordinal 0."""
    return F.format_string(prefix + "_%05d", ordinal + 1)
