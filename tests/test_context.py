"""Budgeted prompts against a plain statement of the steps, over random files and over all rows of the registered query."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelens.functions.text import CODE_END, CODE_START
from tracelens.operators import context
from tracelens.plans import catalogue

KIND = (
    "i int, budget long, path string, lines array<string>, error string, error_ids array<string>, line long, frames array<struct<line:bigint,function:string,code:string,is_target:boolean>>, "
    "findings array<struct<code:string,line:bigint,message:string>>, functions array<struct<name:string,start:bigint,end:bigint>>, classes array<struct<name:string,start:bigint,end:bigint>>"
)


def windows_of(start, end, center, total):
    out = [(start, end)]
    while end - start > 6:
        new = (max(1, center - max(3, (center - start) // 2)), min(total, center + max(3, (end - center) // 2)))
        if new == (start, end):
            break
        start, end = new
        out.append(new)
    return out


def plain(r):
    """(tokens, omitted, start, end, manifest) of the first prompt that fits, or None."""
    lines, line, total = r["lines"], r["line"], len(r["lines"])
    held = [f for f in r["functions"] if line is not None and f[1] <= line <= f[2]]
    inner = min(held, key=lambda f: (f[2] - f[1], r["functions"].index(f)), default=None)
    first = (inner[1], min(total, inner[2])) if inner else (max(1, line - 15), min(total, line + 15)) if line is not None else (1, min(total, 30))
    center = line if line is not None else (first[0] + first[1]) // 2
    narrower = windows_of(*first, center, total)
    tries = [(k, first) for k in range(4)] + [(4, w) for w in narrower[1:]] + [(5, narrower[-1]), (6, narrower[-1]), (7, (center, center))]
    for step, (a, b) in tries:
        shows = lambda x: x[1] <= b and x[2] >= a  # noqa: B023,E731
        in_first = lambda d: first[0] <= d[1] <= first[1]
        near = [d for d in r["findings"] if step < 5 and a <= d[1] <= b and in_first(d)]
        far = [d for d in r["findings"] if step < 1 and not in_first(d)][:3]
        target, external = [f for f in r["frames"] if step < 6 and f[3]], [f for f in r["frames"] if step < 3 and not f[3]]
        outline = [f for f in r["functions"] if step < 2 and not shows(f)][:3]
        ids = [*r["error_ids"], *(f"traceback:line_{f[0]}" for f in target), *(f"ast:function:{f[0]}" for f in r["functions"] if shows(f)), *(f"ast:class:{c[0]}" for c in r["classes"] if shows(c)),
               f"source:lines_{a}-{b}", *(f"ruff:{d[0]}:line_{d[1]}" for d in near + far), *(f"ast:function:{f[0]}" for f in outline)]
        ids = list(dict.fromkeys(ids))
        shown = "\n".join(f"{n}: {lines[n - 1]}" for n in range(a, b + 1) if n <= total)
        body = [f"# ... [{a - first[0]} earlier lines omitted] ..."] * (a > first[0]) + [shown] + [f"# ... [{first[1] - b} later lines omitted] ..."] * (first[1] > b)
        told = lambda title, xs: f"### {title}\n" + "\n".join(xs) if xs else None
        say = lambda d: f"{d[0]} at line {d[1]}: {d[2]}"
        parts = [
            f"Target: {r['path']} ({total} lines)", told("Evidence (cite these only)", [f"- {x}" for x in ids]), f"### Failure\n{r['error']}",
            told("Traceback", [f"line {f[0]} in {f[1]}: {f[2]}" for f in target] + [f"[external] line {f[0]} in {f[1]}" for f in external]),
            "### Source\n" + CODE_START + "\n" + "\n".join(body).replace("<<<", "<\\<<").replace(">>>", ">\\>>") + "\n" + CODE_END,
            told("Findings", map(say, near) and [say(d) for d in near]), told("Other findings", [say(d) for d in far]), told("Outline", [f"{f[0]} lines {f[1]}-{f[2]}" for f in outline]),
        ]
        tokens = max(1, math.ceil(len("\n\n".join(p for p in parts if p)) / 3.5 * 1.15))
        if tokens <= r["budget"]:
            return tokens, list(context.STEPS[:step]), a, b, ids
    return None


def test_steps_against_plain_statement(spark):
    rng = random.Random(5)
    rows = []
    for i in range(250):
        n = rng.randint(1, 90)
        span = lambda: (lambda a: (a, min(n, a + rng.randint(0, 40))))(rng.randint(1, n))  # noqa: B023,E731
        rows.append((i, rng.choice([60, 120, 180, 240, 300, 380, 500, 700, 1200]), "a.py", [rng.choice(["x = 1", "<<<y>>>", "", "call(a, b, c, d)"]) for _ in range(n)], "ValueError: bad", ["runtime:ValueError"],
                     rng.choice([None, rng.randint(1, n)]), [(rng.randint(1, n), "run", "x", rng.random() < 0.5) for _ in range(rng.randint(0, 4))], [(f"E{k}", rng.randint(1, n), "text") for k in range(rng.randint(0, 7))],
                     [(f"f{k}", *span()) for k in range(rng.randint(0, 6))], [(f"C{k}", *span()) for k in range(rng.randint(0, 2))]))
    names = [x.split(" ")[0] for x in "i int, budget long, path s, lines s, error s, error_ids s, line s, frames s, findings s, functions s, classes s".split(", ")]
    got = {r.i: r.context for r in context.diagnosis(spark.createDataFrame(rows, KIND).repartition(3), F.col("budget")).select("i", "context").collect()}
    want = {r[0]: plain(dict(zip(names, r))) for r in rows}
    assert {i: c and (c.tokens, c.omitted, c.start, c.end, c.manifest) for i, c in got.items()} == want
    assert {None if w is None else len(w[1]) for w in want.values()} >= {None, 0, 1, 2, 3, 4, 5, 6}


def test_all_rows_of_the_query(spark):
    sf = "/root/testdata/sf0.001"
    from tracelens.plans.programs import programs

    got = {r.doc_id: None if r.tokens is None else (r.tokens, r.omitted, r.start, r.end, r.manifest) for r in catalogue.queries()["d18_diagnosis_context"](spark, sf).collect()}
    for r in programs(spark, sf).collect():
        lines = (r.source_code + "# filler line of the file\n" * (r.doc_id % 40)).splitlines()
        row = {"lines": lines, "line": r.fault_line, "functions": [], "classes": [], "findings": [("E1", 1, "first line")], "frames": [(r.fault_line, "main", r.faulty, True)], "error_ids": [f"runtime:{r.category}"],
               "path": r.target_file, "error": r.category, "budget": 260}
        assert got.pop(r.doc_id) == plain(row)
    assert not got


def test_budget_above_the_ceiling_fails(spark):
    parts = lambda p, *more: spark.range(1).select(context.partition(F.lit(p), *map(F.lit, more)).alias("p")).head().p
    assert tuple(parts(1200)) == (1200, 600, 248) and tuple(parts(100, 100, 300)) == (100, 100, 100)
    for bad in ((1201,), (1200, 900, 2048)):
        with pytest.raises(Exception, match="budget"):
            parts(*bad)


def test_no_try_after_the_one_that_fits(spark):
    """A row that fits as it is is rendered once: counting the tokens of any narrower try fails here."""
    none = "cast(array() as array<struct<name:string,start:bigint,end:bigint>>)"
    row = spark.range(1).select(
        F.lit("a.py").alias("path"), F.array_repeat(F.lit("x = 1"), 200).alias("lines"), F.lit("e").alias("error"), F.array(F.lit("runtime:e")).alias("error_ids"), F.lit(90).cast("long").alias("line"),
        F.expr("cast(array() as array<struct<line:bigint,function:string,code:string,is_target:boolean>>)").alias("frames"), F.expr("cast(array() as array<struct<code:string,line:bigint,message:string>>)").alias("findings"),
        F.expr(none).alias("functions"), F.expr(none).alias("classes"),
    )
    narrow = lambda p: F.when(p.contains("lines omitted"), F.raise_error(F.lit("a narrower try")).cast("long")).otherwise(F.length(p).cast("long"))
    assert context.diagnosis(row, F.lit(1200), narrow).select("context").head()[0].omitted == []
    with pytest.raises(Exception, match="a narrower try"):
        context.diagnosis(row, F.lit(100), narrow).select("context").collect()
    assert context.diagnosis(row, F.lit(3)).select("context").head()[0] is None
