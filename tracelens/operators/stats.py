"""Grouped and global statistics over runs, samples and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

By = Sequence[str]


def share(part: Column, whole: Column) -> Column:
    """Percentage, 0.0 where the whole is 0."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def count_of(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


#: Accuracy of the sketches that bound a median, and how far below and above the middle they look; the latter must be larger than 1 / ACCURACY.
ACCURACY, AROUND = 10_000, 0.001


def grouped(rows: DataFrame, by: By, aggregates: Sequence[Column], medians: dict[str, Column]) -> DataFrame:
    """Groups (none: all rows) with aggregates and exact medians (null where a group has no value), in the order given.

    No task holds a group's values, and however many medians there are, rows are read for the aggregates and sketches, and once more for all medians
    together. Sketches of bounded size give two values that enclose each median; values below them are counted, those between are counted one by
    one, a few thousandths of a group, and a window over these distinct values finds the middle ranks.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    values = [f"__v{i}" for i in range(len(medians))]
    source = rows.select("*", *[F.col(b).alias(k) for b, k in zip(by, keys)], *[c.cast("double").alias(v) for c, v in zip(medians.values(), values)])
    ends = F.array(F.lit(0.5 - AROUND), F.lit(0.5 + AROUND))
    bounds = [x for v in values for x in (F.percentile_approx(v, ends, F.lit(ACCURACY)).alias(f"__at{v}"), F.count(v).alias(f"__n{v}"))]
    base = source.groupBy(*keys).agg(*aggregates, *bounds)
    names = [c for c in base.columns if not c.startswith("__")]
    if not medians:
        return base.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *names)

    each = F.array(*[F.struct(F.lit(i).alias("__m"), F.col(f"__at{v}")[0].alias("__low"), F.col(f"__at{v}")[1].alias("__high"), F.col(f"__n{v}").alias("__n")) for i, v in enumerate(values)])
    limits = base.select(*[F.col(k).alias(f"{k}_") for k in keys], F.inline(each))
    spread = source.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(v).alias("__v")) for i, v in enumerate(values)])).alias("__x")).select(*keys, "__x.*") if len(values) > 1 else source.select(*keys, F.lit(0).alias("__i"), F.col(values[0]).alias("__v"))
    same = F.col("__i") == F.col("__m")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    # One row a median where there are no groups.
    near = spread.filter("__v is not null").join(limits if keys else F.broadcast(limits), same).filter("__v <= __high")
    inside = F.col("__v") >= F.col("__low")
    counts = near.groupBy(*keys, "__i", "__n", F.when(inside, F.col("__v")).alias("__value")).agg(F.count(F.lit(1)).alias("__c"))

    upto = F.sum("__c").over(Window.partitionBy(*keys, "__i").orderBy(F.col("__value").asc_nulls_first()))
    placed = counts.withColumn("__upto", upto)
    holds = lambda rank: ((F.col("__upto") - F.col("__c") <= rank) & (rank < F.col("__upto"))).cast("double")
    low, high = holds(F.floor((F.col("__n") - 1) / 2)), holds(F.floor(F.col("__n") / 2))
    picked = placed.withColumn("__w", 0.5 * low + 0.5 * high).filter("__w > 0")

    def middle(i: int) -> Column:
        own = F.col("__i") == i
        found = F.sum(F.when(own & F.col("__value").isNotNull(), F.col("__w")))
        lost = F.raise_error(F.lit("a median lies outside the bounds of its sketch")).cast("double")
        return F.when(F.count_if(own) == 0, None).when(found == 1, F.sum(F.when(own, F.col("__w") * F.col("__value")))).otherwise(lost)

    middles = picked.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(*[middle(i).alias(f"__m{i}") for i in range(len(values))])
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        out = base.join(middles, same, "left")
    else:
        out = base.crossJoin(F.broadcast(middles))  # a single row
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *names, *[F.col(f"__m{i}").alias(m) for i, m in enumerate(medians)])


def summarize(samples: DataFrame, by: By, passed: Column, schema_valid: Column, duration: Column, peak: Column) -> DataFrame:
    """Suite summary: counts, unrounded percentages, latency statistics and greatest peak (0 without one)."""
    total, ok, valid = F.count(F.lit(1)), count_of(passed), count_of(schema_valid)
    return grouped(samples, by, [
        total.alias("total"), ok.alias("passed"), (total - ok).alias("failed"), valid.alias("schema_valid"),
        share(ok, total).alias("accuracy_pct"), share(valid, total).alias("schema_valid_pct"),
        F.min(duration).alias("min_ms"), F.max(duration).alias("max_ms"), F.avg(duration).alias("mean_ms"),
        F.coalesce(F.max(peak), F.lit(0)).cast("long").alias("peak_bytes"),
    ], {"median_ms": duration})


def scorecard(samples: DataFrame, by: By, flags: dict[str, Column], diff_lines: Column, duration: Column) -> DataFrame:
    """Counts and percentages to one decimal of each flag, mean diff lines, latency statistics."""
    total = F.count(F.lit(1))
    out = [total.alias("total")]
    for name, flag in flags.items():
        out += [count_of(flag).alias(f"{name}_count"), F.round(share(count_of(flag), total), 1).alias(f"{name}_pct")]
    out.append(F.round(F.avg(diff_lines), 1).alias("avg_diff_lines"))
    out += [F.round(f(duration), 1).alias(f"{name}_ms") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    cards = grouped(samples, by, out, {"median_ms": duration})
    return cards.withColumn("median_ms", F.round("median_ms", 1))


def comparison(cards: DataFrame, model: str, base: str, tuned: str, pcts: By) -> DataFrame:
    """Deltas, to one decimal, of the tuned model's scorecard against the base model's: hallucinations and diff lines count
    how far they fell, all others how far they rose. Both cards come from one pass over conditional aggregates."""
    def of(name: str, who: str) -> Column:
        return F.max(F.when(F.col(model) == who, F.col(name)))

    deltas = [F.round(of(p, tuned) - of(p, base), 1).alias(f"{p}_delta") for p in pcts]
    lines = of("avg_diff_lines", base)
    return cards.filter(F.col(model).isin(base, tuned)).agg(
        *deltas,
        F.when(lines > 0, F.round((lines - of("avg_diff_lines", tuned)) / lines * 100.0, 1)).otherwise(0.0).alias("diff_reduction_pct"),
        F.round(of("hallucinated_pct", base) - of("hallucinated_pct", tuned), 1).alias("hallucination_reduction_pct"),
        F.round(of("median_ms", tuned) - of("median_ms", base), 1).alias("latency_delta_ms"),
    )


def grand_total(summaries: DataFrame, clean: Column) -> DataFrame:
    """Totals over suite summaries, the overall percentage, and whether all are clean."""
    total, ok = F.sum("total"), F.sum("passed")
    return summaries.agg(total.alias("total"), ok.alias("passed"), (total - ok).alias("failed"), share(ok, total).alias("accuracy_pct"), F.bool_and(clean).alias("all_clean"))


def timing(rows: DataFrame, by: By, value: str) -> DataFrame:
    """Count, median, least, greatest, mean and sample deviation (0.0 of one value)."""
    return grouped(rows, by, [
        F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"),
    ], {"median": F.col(value)})


def token_stats(rows: DataFrame, by: By, tokens: str) -> DataFrame:
    found = grouped(rows, by, [
        F.coalesce(F.min(tokens), F.lit(0)).alias("least"), F.coalesce(F.max(tokens), F.lit(0)).alias("most"), F.coalesce(F.round(F.avg(tokens), 2), F.lit(0.0)).alias("mean"),
    ], {"median": F.col(tokens)})
    return found.withColumn("median", F.coalesce(F.round("median", 2), F.lit(0.0)))


def frequency_tables(rows: DataFrame, columns: By) -> DataFrame:
    """Count and percentage to two decimals of each value of each column, in one pass: rows (dimension, value, n, pct).

    One expanded aggregate serves all columns; the total is a sum over the small result.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("dimension"))
    return counts.select("dimension", "value", "n", F.round(share(F.col("n"), total), 2).alias("pct"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Rows of each group and their percentage, to two decimals, of all rows."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(share(F.col("n"), F.sum("n").over(Window.partitionBy())), 2))


def grouped_lists(rows: DataFrame, by: By, order: str, value: str) -> DataFrame:
    """Values of each group in order."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("items"))


def distinct_in_order(rows: DataFrame, by: By, order: str, value: str) -> DataFrame:
    """Distinct values of each group by their first occurrence, equal places by value: repeats combine before a group is gathered."""
    firsts = rows.groupBy(*by, value).agg(F.min(F.struct(order, value)).alias("first"))
    return firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x[value]).alias("items"))


def peaks(samples: DataFrame, by: By, value: str, failed: Column) -> DataFrame:
    """Greatest sample and number of samples; failed samples count, without a value."""
    return samples.groupBy(*by).agg(F.coalesce(F.max(F.when(~failed, F.col(value))), F.lit(0.0)).alias("peak"), F.count(F.lit(1)).alias("n"), count_of(failed).alias("n_failed"))


def tree_sums(nodes: DataFrame, value: str, sample: str | None = None) -> DataFrame:
    """Sum of ``value`` over each root (null parent) and its descendants, from rows (id, parent, value); with ``sample``, ids are of one sample each.

    Pointer doubling: after k rounds each node points 2^k ancestors up, so a chain of depth d takes log d joins, each on keys that are unique
    on one side. Rounds go on until no pointer is left and are written, so lineage stays short; pointers that are left when a chain can't be longer belong
    to a cycle, which fails. A parent that has no row of its own is the root of what points to it. Nodes without an id point nowhere.
    """
    own = [sample] if sample else []
    hops = nodes.select(*own, "id", F.col("parent").alias("up"), F.coalesce("parent", "id").alias("root"), value)
    total = None
    for k in range(64):
        above = hops.select(*[F.col(c).alias(f"__{c}") for c in own], F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("root").alias("__root"))
        same = F.col("up") == F.col("__id")
        for c in own:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        hops = written(hops.join(above, same, "left").select(*own, "id", F.col("__up").alias("up"), F.coalesce("__root", "root").alias("root"), value), "hops")
        total, left = hops.agg(F.count(F.lit(1)), F.count("up")).head()
        if not left:
            break
        if 1 << k > total:
            raise ValueError("tree_sums: the parents have a cycle")
    return hops.groupBy(*own, "root").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def verdicts(rows: DataFrame, by: By, established: Column, broken: Column) -> DataFrame:
    """Whether all rows of a group are established and any is broken; a group of none is neither."""
    return rows.groupBy(*by).agg(F.bool_and(established).alias("all_established"), F.bool_or(broken).alias("any_broken"))


def parse_rate(texts: DataFrame, order: str, ok: Column, first: int = 50) -> DataFrame:
    """Share of the first texts that parse, to four decimals; 1.0 of none. The limit is the measure's own."""
    return texts.orderBy(order).limit(first).agg(F.coalesce(F.round(F.avg(ok.cast("double")), 4), F.lit(1.0)).alias("rate"))


def mean_loss(rows: DataFrame, by: By, loss: str) -> DataFrame:
    """Mean over losses that are numbers; null where none is."""
    return rows.groupBy(*by).agg(F.avg(F.when(~F.isnan(loss), F.col(loss))).alias("loss"))


def collected_errors(rows: DataFrame, key: str, errors: Column) -> DataFrame:
    """(key, index, error) of every error of every row."""
    return rows.select(key, F.posexplode(errors).alias("index", "error")).withColumn("index", F.col("index").cast("long"))


def innermost_frame(frames: Column, target: Column) -> Column:
    """Struct (file, line) of the last target frame, else of the last frame, else the target without a line; ``frames`` are in order."""
    ours = F.filter(frames, lambda f: f["is_target"])
    top = F.when(F.size(ours) > 0, F.element_at(ours, -1)).when(F.size(frames) > 0, F.element_at(frames, -1))
    return F.struct(F.coalesce(top["file"], target).alias("file"), top["line"].cast("long").alias("line"))
