"""Which finding of a candidate is which of its baseline: greedy pairing in three passes, in Spark.

Within a file, code and line, baseline findings choose in order of id, first among candidates of equal column and message, then of either,
then of any; the earliest that is left wins. The first pass and the last pair the k-th with the k-th, so they are ranks
(``scan.running``), whose groups may be of any size. The second is that too where columns or messages say nothing, because all leftovers of a line share one, or
because no value stands on both sides. Only lines between are walked through, in order, as a stream of sorted rows.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .scan import running

LINE = ["file", "code", "line"]
PAIRED = "file {file}, baseline_id {id}, candidate_id {id}, outcome string"


def by_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th of the baseline's rows (side 0) with the k-th of the candidate's (side 1) under equal keys: (keys, line's keys, b, c), structs (id, col, message), one of
    them null where a side has no k-th row."""
    ranked = running(rows, [*keys, "side"], ["id"], sums={"__rank": F.lit(1)})
    own = lambda side: F.max(F.when(F.col("side") == side, F.struct("id", "col", "message")))
    return ranked.groupBy(*keys, "__rank").agg(own(0).alias("b"), own(1).alias("c"))


def outcome(pairs: DataFrame) -> DataFrame:
    found = F.when(F.col("b").isNull(), "introduced").when(F.col("c").isNull(), "eliminated").otherwise("pre_existing")
    return pairs.select("file", F.col("b.id").alias("baseline_id"), F.col("c.id").alias("candidate_id"), found.alias("outcome"))


def leftovers(pairs: DataFrame) -> DataFrame:
    """The rows (side, id, col, message) that found no partner."""
    one = F.coalesce("b", "c")
    return pairs.filter("b is null or c is null").select(*LINE, F.when(F.col("b").isNull(), 1).otherwise(0).alias("side"), one["id"].alias("id"), one["col"].alias("col"), one["message"].alias("message"))


def tangled_lines(rows: DataFrame) -> DataFrame:
    """Lines whose leftovers must be walked through: they stand on both sides, share some column or message, and neither is the same for all."""
    shared = lambda c: rows.groupBy(*LINE, c).agg((F.count_distinct("side") == 2).alias("both")).groupBy(*LINE).agg(F.bool_or("both").alias("shared"), (F.count(F.lit(1)) > 1).alias("several"))
    marks = shared("col").unionByName(shared("message"))
    return marks.groupBy(*LINE).agg(F.bool_or("shared").alias("shared"), F.bool_and("several").alias("several")).filter("shared and several").select(*LINE)


class Pool:
    """Open candidates of a line: queues by column and by message, and all, each in order of id; taken ones are skipped when a queue comes to them."""

    def __init__(self):
        self.by: dict[tuple, deque] = {}
        self.open: set = set()
        self.order: list = []

    def add(self, id_, col, message):
        self.order.append(id_)
        self.open.add(id_)
        for key in (("col", col), ("message", message)):
            self.by.setdefault(key, deque()).append(id_)

    def first(self, key):
        queue = self.by.get(key, ())
        while queue and queue[0] not in self.open:
            queue.popleft()
        return queue[0] if queue else None

    def take(self, col, message):
        """The earliest candidate of equal column or message; None if there is none."""
        found = [x for x in (self.first(("col", col)), self.first(("message", message))) if x is not None]
        if not found:
            return None
        self.open.discard(min(found))
        return min(found)


def walk(rows: DataFrame) -> DataFrame:
    """Pairs of tangled lines: a stream of rows sorted by line, candidates before baseline, and id; memory is that of one line's leftovers."""
    id_type, file_type = (rows.schema[c].dataType.simpleString() for c in ("id", "file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pool, waiting, out, schema = None, Pool(), [], [], None

        def close():
            rest = iter(sorted(x for x in pool.order if x in pool.open))
            for b in waiting:
                c = next(rest, None)
                out.append((at[0], b, c, "pre_existing" if c is not None else "eliminated"))
            out.extend((at[0], None, c, "introduced") for c in rest)

        for batch in batches:
            schema = schema or pa.schema([("file", batch.schema.field("file").type), ("baseline_id", batch.schema.field("id").type), ("candidate_id", batch.schema.field("id").type), ("outcome", pa.string())])
            for file, code, line, side, id_, col, message in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (file, code, line) != at:
                    if at is not None:
                        close()
                    at, pool, waiting = (file, code, line), Pool(), []
                if side:
                    pool.add(id_, col, message)
                elif (c := pool.take(col, message)) is not None:
                    out.append((file, id_, c, "pre_existing"))
                else:
                    insort(waiting, id_)
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out.clear()
        if at is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    order = rows.select(*LINE, "side", "id", "col", "message").repartition(*LINE).sortWithinPartitions(*LINE, F.col("side").desc(), "id")
    return order.mapInArrow(run, PAIRED.format(file=file_type, id=id_type))


def diff_pairs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(file, baseline_id, candidate_id, outcome) of findings (id, file, code, line, col, message).

    ``line`` of a baseline finding is where it stands now, null if its line was edited: it is eliminated, as a candidate without a line is introduced.
    Null codes, columns and messages are equal to each other. ids are unique in each side.
    """
    columns = [*LINE, "id", "col", "message"]
    both = baseline.select(*columns, F.lit(0).alias("side")).unionByName(candidate.select(*columns, F.lit(1).alias("side")))
    none = both.filter("line is null").select(*LINE, *[F.when(F.col("side") == s, F.struct("id", "col", "message")).alias(n) for s, n in ((0, "b"), (1, "c"))])
    exact = written(by_rank(both.filter("line is not null"), [*LINE, "col", "message"]).select(*LINE, "b", "c"), "pairs")
    left = leftovers(exact)
    tangled = written(tangled_lines(left), "tangled")
    same = lambda a: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"t.{k}")) for k in LINE]
    plain = written(left.alias("l").join(tangled.alias("t"), same("l"), "left_anti"), "left")
    mixed = left.alias("l").join(tangled.alias("t"), same("l"), "left_semi")
    any_ = by_rank(plain, LINE).select(*LINE, "b", "c")
    return outcome(exact.filter("b is not null and c is not null")).unionByName(outcome(any_)).unionByName(outcome(none)).unionByName(walk(mixed))
