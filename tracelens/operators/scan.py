"""Running sums, greatest and last values over ordered groups of any size, and the sweeps and as-of joins that rest on them.

A group may hold a third of all rows, so it is never ordered in one task: bounds from a sample of hashed rows part all rows, in order of group and
key, into ranges of about equal size. Each range runs by itself; what the ranges before hand on to the same group is one row for each range
that goes on with a group of the one before, fewer rows than there are ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .edits import is_new_line, map_line

#: Sampled rows for each bound.
SAMPLED = 64
#: Edits of a file that each of its lines is held against in place.
FEW_EDITS = 16


def range_count(rows: DataFrame) -> int:
    return max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ordered_parts(rows: DataFrame, keys: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the number of the range, by order of the keys (nulls first), that a row lies in; ranges are of about equal size, rows with equal keys share one.

    The bounds are every SAMPLED-th of the rows with the smallest hashes, some thousands on the driver; they decide how even the ranges are and nothing else.
    """
    parts = parts or range_count(rows)
    sample = rows.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLED * parts)
    found = sample.orderBy(*keys).collect()[SAMPLED // 2 :: SAMPLED]
    if not found:
        return rows.withColumn(name, F.lit(0))
    kinds = [rows.schema[k].dataType for k in keys]
    bounds = F.array(*[F.struct(*[F.lit(x).cast(t).alias(k) for x, t, k in zip(b, kinds, keys)]) for b in found])
    at = F.struct(*keys)
    steps = [1 << i for i in reversed(range(len(found).bit_length()))]
    step = lambda a, s: F.when((a + s <= len(found)) & (F.get(bounds, a + s - 1) <= at), a + s).otherwise(a)
    return rows.withColumn(name, F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step))


def running(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    greatest: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    xors: dict[str, Column] | None = None,
    before: bool = False,
    parts: int | None = None,
    cut_by: Sequence[str] | None = None,
) -> DataFrame:
    """Adds running values of each group in order (nulls first): sums (0 of none), greatest values and last values that are not null (null of none), exclusive-or (0 of none).

    They go up to each row, or up to the row before with ``before``. Rows that ``order`` leaves equal come in any order. ``cut_by``: the first keys of ``order``, by which
    ranges are cut (all of them), where others are long texts.
    """
    sums, greatest, last, xors = sums or {}, greatest or {}, last or {}, xors or {}
    values = {**sums, **greatest, **last, **xors}
    dealt = ordered_parts(rows.withColumns({f"__v_{k}": v for k, v in values.items()}), [*by, *(cut_by or order)], "__part", parts)

    upto = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    fold = {**{k: F.sum for k in sums}, **{k: F.max for k in greatest}, **{k: lambda c: F.last(c, ignorenulls=True) for k in last}, **{k: F.bit_xor for k in xors}}
    own = dealt.withColumns({f"__own_{k}": fold[k](F.col(f"__v_{k}")).over(upto) for k in values})

    place = F.struct(*order)
    ends = {**fold, **{k: lambda c: F.max_by(c, F.when(c.isNotNull(), place)) for k in last}}
    totals = dealt.groupBy(*by, "__part").agg(*[ends[k](F.col(f"__v_{k}")).alias(f"__t_{k}") for k in values])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumns({"__later": F.count(F.lit(1)).over(earlier) > 0, **{f"__c_{k}": fold[k](F.col(f"__t_{k}")).over(earlier) for k in values}}).filter("__later")
    carried = carried.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), *[f"__c_{k}" for k in values])
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    both = own.join(F.broadcast(carried), same, "left")  # fewer rows than there are ranges

    zero = F.lit(0)
    found = {k: F.coalesce(F.col(f"__own_{k}"), zero) + F.coalesce(F.col(f"__c_{k}"), zero) for k in sums}
    found |= {k: F.greatest(f"__own_{k}", f"__c_{k}") for k in greatest}
    found |= {k: F.coalesce(f"__own_{k}", f"__c_{k}") for k in last}
    found |= {k: F.coalesce(F.col(f"__own_{k}"), zero).bitwiseXOR(F.coalesce(F.col(f"__c_{k}"), zero)) for k in xors}
    return both.select(*rows.columns, *[v.alias(k) for k, v in found.items()])


def as_of(points: DataFrame, facts: DataFrame, by: Sequence[str], at: str, sums: Sequence[str] = (), greatest: Sequence[str] = (), last: Sequence[str] = (), strictly: bool = False) -> DataFrame:
    """``points`` with what the ``facts`` of their group say up to each point: sums, greatest and last values of columns of ``facts`` (by, at, ...) whose
    ``at`` is at most, or less than, the point's.

    Both sides go into one sorted union, so a point meets no list of facts: n log n for any number of facts. Names that begin with __ are taken.
    """
    told = [*sums, *greatest, *last]
    here = points.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(at).alias("__at"), F.lit(0 if strictly else 1).alias("__kind"), F.struct(*points.columns).alias("__point"), *[F.lit(None).cast(facts.schema[c].dataType).alias(f"__f_{c}") for c in told])
    there = facts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(at).alias("__at"), F.lit(1 if strictly else 0).alias("__kind"), F.lit(None).cast(here.schema["__point"].dataType).alias("__point"), *[F.col(c).alias(f"__f_{c}") for c in told])
    of = lambda names: {n: F.col(f"__f_{n}") for n in names}
    both = running(here.unionByName(there), [f"__by{i}" for i in range(len(by))], ["__at", "__kind"], of(sums), of(greatest), of(last))
    return both.filter("__point is not null").select("__point.*", *told)


def mapped_lines(lines: DataFrame, edits: DataFrame, by: str, line: str) -> DataFrame:
    """``lines`` with ``mapped``: where a line stands after the edits of its file; null below 1 or where an edit replaces or deletes it.

    ``edits``: rows (by, insert, start, end, new, old), counts of lines. An edit shifts all lines after it, and covers those from start to end.
    """
    shifts = edits.select(by, F.when(F.col("insert"), F.col("start")).otherwise(F.col("end") + 1).alias(line), (F.col("new") - F.col("old")).alias("__shift"), F.lit(None).cast("long").alias("__covered"))
    covers = edits.filter(~F.col("insert")).select(by, F.col("start").alias(line), F.lit(0).cast("long").alias("__shift"), F.col("end").alias("__covered"))
    facts = shifts.union(covers).select(by, line, F.col("__shift").alias("edit_shift"), F.col("__covered").alias("edit_end"))
    found = as_of(lines, facts, [by], line, sums=["edit_shift"], greatest=["edit_end"])
    gone = F.coalesce(F.col("edit_end") >= F.col(line), F.lit(False))
    return found.select(*lines.columns, F.when((F.col(line) >= 1) & ~gone, F.col(line) + F.col("edit_shift")).alias("mapped"))


def new_lines(lines: DataFrame, edits: DataFrame, by: str, line: str) -> DataFrame:
    """``lines`` of the edited texts with ``is_new``: whether one lies in text that an edit of its file put there. See ``mapped_lines``."""
    placed = running(edits, [by], ["start", "end"], sums={"shift": F.col("new") - F.col("old")}, before=True).filter("new > 0")
    facts = placed.select(by, (F.col("start") + F.col("shift")).alias(line), (F.col("start") + F.col("shift") + F.col("new") - 1).alias("edit_last"))
    found = as_of(lines, facts, [by], line, greatest=["edit_last"])
    return found.select(*lines.columns, ((F.col(line) >= 1) & F.coalesce(F.col("edit_last") >= F.col(line), F.lit(False))).alias("is_new"))


def mapped_files(files: DataFrame, by: str, line: str) -> DataFrame:
    """All lines (by, line, mapped) of whole files; see ``mapped_lines`` and ``of_files``."""
    return of_files(files, by, line, "mapped", map_line, mapped_lines)


def new_in_files(files: DataFrame, by: str, line: str) -> DataFrame:
    """All lines (by, line, is_new) of whole files; see ``new_lines`` and ``of_files``."""
    return of_files(files, by, line, "is_new", is_new_line, new_lines)


def of_files(files: DataFrame, by: str, line: str, name: str, in_place: Callable[[Column, Column], Column], joined: Callable[[DataFrame, DataFrame, str, str], DataFrame]) -> DataFrame:
    """Lines 1 to n_lines of each file with what its edits make of them. ``files``: rows (by, n_lines, edits), one a file, edits as ``edits.measured`` gives them.

    What a file's text tells, two numbers and its edits, is written once, so texts are read once. Each line of a file with few edits is held against them where it
    arises, without a shuffle; those of a file with more meet them in a join.
    """
    known = written(files.filter("n_lines > 0").select(by, "n_lines", "edits"), "files")
    some = F.coalesce(F.size("edits"), F.lit(0)) > FEW_EDITS
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_lines"))).alias(line)
    found = known.filter(~some).select(by, F.coalesce("edits", F.array().cast(known.schema["edits"].dataType)).alias("edits"), each).select(by, line, in_place(F.col(line), F.col("edits")).alias(name))
    many = known.filter(some)
    if many.isEmpty():
        return found
    return found.union(joined(many.select(by, each), many.select(by, F.inline("edits")), by, line).select(by, line, name))


def contained(inner: DataFrame, outer: DataFrame, by: str) -> DataFrame:
    """Nodes (by, pre, ...) of ``inner`` that lie below a node (by, pre, post) of ``outer``: a sweep in preorder that keeps the greatest post so far."""
    found = as_of(inner, outer.select(by, "pre", F.col("post").alias("outer_post")), [by], "pre", greatest=["outer_post"], strictly=True)
    return found.filter(F.col("outer_post") >= F.col("pre")).select(*inner.columns)
