"""Tracebacks in recorded output, as rows: each line carries forward the header, paragraph and exception that it belongs to.

Lines are rows, so an output of any length is split among tasks; what a line needs of those before it comes from running values
(``scan.running``), never from a parser that reads a whole output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .scan import running

#: Lines that are no code, and lines that raise (fixed values).
NOISE = r"^\s*\[Previous line repeated \d+ more times\]|^\s*[\^~ ]+$"
RAISED = r"^([a-zA-Z_][a-zA-Z0-9_.]*)(?::\s*(.*))?$"


def output_lines(outputs: DataFrame, key: str, output: str) -> DataFrame:
    """(key, n from 0, line) of each output, without control sequences. Empty and null outputs have no line."""
    plain = F.regexp_replace(T.text_or_empty(output), "|".join(T.CONTROL_SEQUENCES[:3]), "")
    return outputs.select(key, F.posexplode(T.lines(plain)).alias("n", "line"))


def placed_lines(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` (key, n, line) with ``raised`` (number of the last line that raises, up to here), ``continues`` (whether the line belongs to what that line
    says) and ``header`` (number of the frame header that the line belongs to, itself or before; null of none).

    A line that is not indented begins a paragraph; where it raises, its paragraph is the message and ends a stretch, so headers of the stretch
    before no longer count.
    """
    indented = F.col("line").startswith(" ") | F.col("line").startswith("\t")
    frame = F.col("line").rlike(T.FRAME)
    raises = ~indented & ~frame & ~F.col("line").rlike(NOISE) & F.col("line").rlike(RAISED)
    n = F.col("n").cast("long")
    told = running(lines, [key], ["n"], last={"raised": F.when(raises, n), "paragraph": F.when(~indented, n)})
    told = told.withColumn("continues", F.coalesce(F.col("raised") == F.col("paragraph"), F.lit(False)))
    headed = running(told, [key], ["n"], last={"header": F.when(frame & ~F.col("continues"), n)})
    own = ~F.col("continues") & (F.coalesce("raised", F.lit(-1)) < F.col("header"))
    return headed.withColumn("header", F.when(own, F.col("header"))).drop("paragraph")


def joined(order: Column, part: Column, between: str) -> Column:
    """Aggregate: parts that are not null in order, as one text."""
    listed = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(order.alias("n"), part.alias("t")))))
    return F.array_join(listed["t"], between)


def frames(placed: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """(key, header, file, line, function, code, is_target) of each frame; code is its indented lines that are no marks, the file of a target frame is the target."""
    inside = F.col("header").isNotNull() & (F.col("n") > F.col("header")) & F.substring("line", 1, 1).isin(" ", "\t") & ~F.col("line").rlike(NOISE)
    head = F.max(F.when(F.col("n") == F.col("header"), F.col("line")))
    found = placed.filter("header is not null").groupBy(key, "header").agg(head.alias("head"), T.strip(joined(F.col("n"), F.when(inside, T.strip("line")), "\n")).alias("code"))
    fields = found.select(key, "header", "code", T.frame_fields("head").alias("f")).join(targets.select(key, target), key)
    name = lambda c: F.regexp_extract(F.col(c), r"([^/\\]*)$", 1)
    ours = name("f.file") == name(target)
    return fields.select(key, "header", F.when(ours, F.col(target)).otherwise(F.col("f.file")).alias("file"), "f.line", "f.function", "code", ours.alias("is_target"))


def exceptions(placed: DataFrame, key: str) -> DataFrame:
    """(key, type, message) of the last exception of each output: the last line that raises, with all that continues it; without one the last line that would
    raise if it were not indented. Outputs without either are left out."""
    part = lambda x, g: F.regexp_extract(x, RAISED, g)
    bare = T.strip("line")
    last = placed.groupBy(key).agg(F.max("raised").alias("__last"), F.max_by(F.when(bare.rlike(RAISED), bare), F.when(bare.rlike(RAISED), F.col("n"))).alias("loose"))
    own = placed.filter("continues").join(last.select(F.col(key).alias("__key"), "__last"), (F.col(key) == F.col("__key")) & (F.col("raised") == F.col("__last")))
    text = F.when(F.col("n") == F.col("raised"), part(F.col("line"), 2)).otherwise(T.strip("line"))
    raised = own.groupBy(F.col("__key").alias("__key")).agg(F.max(F.when(F.col("n") == F.col("raised"), part(F.col("line"), 1))).alias("type"), T.strip(joined(F.col("n"), F.when(text != "", text), " ")).alias("message"))
    both = last.join(raised, F.col(key) == F.col("__key"), "left").filter("type is not null or loose is not null")
    return both.select(key, F.coalesce("type", part(F.col("loose"), 1)).alias("type"), F.coalesce("message", T.strip(part(F.col("loose"), 2))).alias("message"))


def tracebacks(outputs: DataFrame, key: str, output: str, target: str) -> DataFrame:
    """(key, type, message, file, line, n_frames) of each output: its last exception, and where: the last target frame, else the last frame, else the target
    without a line. Without an exception type, message, file and line are null. ``key`` is unique and not null.
    """
    placed = written(placed_lines(output_lines(outputs, key, output), key), "placed-lines")
    place = F.struct("is_target", "header")
    top = frames(placed, outputs, key, target).groupBy(key).agg(F.count(F.lit(1)).alias("n_frames"), F.max_by(F.struct("file", "line"), place).alias("top"))
    out = outputs.select(key, target).join(exceptions(placed, key), key, "left").join(top, key, "left")
    known = F.col("type").isNotNull()
    return out.select(key, "type", "message", F.when(known, F.coalesce("top.file", target)).alias("file"), F.when(known, F.col("top.line")).alias("line"), F.coalesce("n_frames", F.lit(0)).cast("long").alias("n_frames"))
