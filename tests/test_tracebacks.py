"""Tracebacks from line tables against the parser of whole outputs, with outputs that are split among tasks."""

import random

from pyspark.sql import functions as F

from tracelens.functions import pysource
from tracelens.operators import tracebacks

ONE = 'Traceback (most recent call last):\n  File "/tmp/s/app.py", line 12, in compute\n    return a / b\n           ~~^~~\nZeroDivisionError: division by zero\n'
PIECES = [
    ONE, "\nDuring handling of the above exception, another exception occurred:\n\n", '  File "app.py", line 7, in <module>\n    main()\nRuntimeError: boom\n  more\n\tand  more \n', '  File "/lib/x\\app.py", line 0\n', '    code\n', "      ^^^^\n",
    '  File "/lib/other.py", line 99999999999999999999, in f\n', "plain words here\n", "   MyError: x\n", "a.b.C\n", "KeyError:   \r\n", "\x1b[31mValueError: red\x1b[0m\n", "\x1b]0;title\x07", "  [Previous line repeated 3 more times]\n", "\n", " \n",
    'File "top.py", line 3\n', "Ünder: no\n", "_x: y: z\x0c", "    late code\n", "Traceback (most recent call last):\n",
]


def outputs():
    rng = random.Random(11)
    texts = ["", None, ONE, "   MyError: x", ONE * 3, "x", "\x1b[0m", PIECES[2] + PIECES[4] * 3 + PIECES[3]]
    return texts + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(250)]


def test_equal_to_the_parser(spark):
    texts = outputs()
    df = spark.createDataFrame([(i, t, "app.py") for i, t in enumerate(texts)], "id long, err string, target string").repartition(3)
    got = {r.id: tuple(r)[1:] for r in tracebacks.tracebacks(df, "id", "err", "target").collect()}
    placed = tracebacks.placed_lines(tracebacks.output_lines(df, "id", "err"), "id")
    frames = {}
    for r in tracebacks.frames(placed, df, "id", "target").orderBy("id", "header").collect():
        frames.setdefault(r.id, []).append({"file": r.file, "line": r.line, "function": r.function, "code": r.code, "is_target": r.is_target})
    for i, t in enumerate(texts):
        want = pysource.parse_traceback(t, "app.py")
        few = [{**f, "line": f["line"] if f["line"] < 1 << 63 else 1} for f in want["frames"]]  # a number that no line has is 1
        line = want["line"] if not want["line"] or want["line"] < 1 << 63 else 1
        assert got[i] == (want["type"], want["message"], want["file"], line, len(few)), t
        assert frames.get(i, []) == few, t


def test_one_output_of_many_lines(spark):
    """A run of 200,000 lines, in rows of their own and in many tasks: every tenth is a header, the one before the last raises."""
    n, at = F.col("id"), F.col("id") % 10
    line = F.when(n == 0, "Traceback (most recent call last):").when(n == 199_998, "ValueError: a").when(n == 199_999, "  b").when(at == 1, F.concat(F.lit('  File "app.py", line '), n.cast("string"), F.lit(", in f"))).otherwise("    code")
    lines = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("run"), n.alias("n"), line.alias("line"))
    placed = tracebacks.placed_lines(lines, "run")
    assert [tuple(r) for r in tracebacks.exceptions(placed, "run").collect()] == [(1, "ValueError", "a b")]
    wrong = (n != 0) & (n < 199_998) & ~F.col("header").eqNullSafe(n - (n + 9) % 10)
    assert placed.filter(F.col("header").isNotNull()).count() == 199_997 and placed.withColumnRenamed("n", "id").filter(wrong).count() == 0
