"""Prompts that fit a token budget: evidence is rendered whole, then dropped or narrowed in a fixed order until it fits.

Everything is one expression over a row: arrays of frames, findings, functions and classes, and the array of source lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .windows import excerpt, shrink

#: Tokens of the context window and its parts; the prompt's part is a ceiling.
WINDOW_TOKENS, MOST_PROMPT, OUTPUT_TOKENS = 2048, 1200, 600


def partition(prompt: Column, output: Column | None = None, window: Column | None = None) -> Column:
    """Struct (prompt, output, margin) of a budget: the parts add up to the window. A prompt above the ceiling, or parts above the window, fail."""
    window, output = F.lit(WINDOW_TOKENS) if window is None else window, F.lit(OUTPUT_TOKENS) if output is None else output
    margin = window - prompt - output
    asked = (
        F.when(prompt > MOST_PROMPT, F.raise_error(F.concat(F.lit("prompt budget above the ceiling: "), prompt.cast("string"))).cast("long"))
        .when(margin < 0, F.raise_error(F.lit("prompt and output budgets exceed the window")).cast("long")).otherwise(prompt.cast("long"))
    )
    return F.struct(asked.alias("prompt"), output.cast("long").alias("output"), margin.cast("long").alias("margin"))


#: What is dropped, in this order.
STEPS = ("secondary_diagnostics", "broader_ast_outline", "external_traceback_frames", "surrounding_lines", "excerpt_diagnostics", "traceback_summary", "single_line")


def fault(signature_line: Column, frames: Column, syntax_line: Column, findings: Column) -> Column:
    """Struct (line, origin) of the fault: the signature's line, else the last target frame's, else the first syntax error's, else the first finding's."""
    ours = F.filter(frames, lambda f: f["is_target"])
    found = [
        (signature_line, "runtime_signature"), (F.when(F.size(ours) > 0, F.element_at(ours, -1)["line"]), "runtime_frame"),
        (syntax_line, "syntax_error"), (F.when(F.size(findings) > 0, F.get(findings, F.lit(0))["line"]), "linter_diagnostic"),
    ]
    line = F.coalesce(*[c.cast("long") for c, _ in found])
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(o)) for c, o in found])
    return F.struct(line.alias("line"), origin.alias("origin"))


def enclosing(functions: Column, line: Column) -> Column:
    """The shortest function (name, start, end) that holds a line, the first of equals; null without one."""
    held = F.filter(functions, lambda f: line.between(f["start"], f["end"]))
    keyed = F.transform(held, lambda f, i: F.struct((f["end"] - f["start"]).alias("size"), i.alias("i"), f.alias("f")))
    return F.array_min(keyed)["f"]


def listed(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"### {title}\n"), F.array_join(items, "\n")))


def manifest(errors: Column, frames: Column, functions: Column, classes: Column, findings: Column, window: Column) -> Column:
    """Distinct evidence identifiers, first occurrence first, of what a prompt shows."""
    shown = lambda x: (x["start"] <= window["end"]) & (x["end"] >= window["start"])
    parts = [
        errors, F.transform(frames, lambda f: T.evidence_id("traceback", f["line"])), F.transform(F.filter(functions, shown), lambda f: T.evidence_id("function", f["name"])),
        F.transform(F.filter(classes, shown), lambda c: T.evidence_id("class", c["name"])), F.array(T.evidence_id("source", window["start"], window["end"])),
        F.transform(findings, lambda d: T.evidence_id("ruff", d["code"], d["line"])),
    ]
    return F.array_distinct(F.concat(*parts))


def diagnosis(rows: DataFrame, budget: Column, tokens: Callable[[Column], Column] = T.estimate_tokens, out: str = "context") -> DataFrame:
    """Adds a struct (prompt, manifest, tokens, omitted, start, end): the fullest prompt within the budget; null where even a single line is too much.

    ``rows`` has path, lines (array of source lines), error and error_ids (the failure's text and identifiers), line (of the fault, or null), frames (line, function,
    code, is_target), findings (code, line, message), functions and classes (name, start, end). A step keeps away what the steps before it dropped;
    narrowing tries each narrower window in turn and leaves the narrowest to the steps after it. A budget above the ceiling fails (``partition``).

    The tries are rendered by one lambda over an array of (step, window), so the plan stays small, in turn and until one fits: of a row that fits as it is one
    prompt is ever built.
    """
    c = F.col
    work = rows.withColumns({"__total": F.size("lines").cast("long"), "__inner": enclosing(c("functions"), c("line"))})
    work = work.withColumn("__first", excerpt(c("__inner.start"), c("__inner.end"), c("line"), c("__total")))
    work = work.withColumn("__center", F.coalesce("line", F.floor((c("__first.start") + c("__first.end")) / 2)).cast("long"))
    work = work.withColumn("__windows", shrink(c("__first.start"), c("__first.end"), c("__center"), c("__total")))
    at = lambda step, w: F.struct(F.lit(step).alias("step"), w["start"].alias("start"), w["end"].alias("end"))
    last = F.element_at("__windows", -1)
    single = F.struct(c("__center").alias("start"), c("__center").alias("end"))
    work = work.withColumn("__tries", F.concat(F.array(*[at(k, c("__first")) for k in range(4)]), F.transform(F.slice("__windows", 2, 64), lambda w: at(4, w)), F.array(at(5, last), at(6, last), at(7, single))))

    def render(v: Column) -> Column:
        """Prompt and manifest once the first ``step`` things are dropped."""
        shows = lambda x: (x["start"] <= v["end"]) & (x["end"] >= v["start"])
        near = F.filter("findings", lambda d: (v["step"] < 5) & d["line"].between(v["start"], v["end"]) & d["line"].between(c("__first.start"), c("__first.end")))
        far = F.slice(F.filter("findings", lambda d: (v["step"] < 1) & ~d["line"].between(c("__first.start"), c("__first.end"))), 1, 3)
        target = F.filter("frames", lambda f: (v["step"] < 6) & f["is_target"])
        external = F.filter("frames", lambda f: (v["step"] < 3) & ~f["is_target"])
        outline = F.slice(F.filter("functions", lambda f: (v["step"] < 2) & ~shows(f)), 1, 3)
        ids = F.array_distinct(F.concat(manifest(c("error_ids"), target, c("functions"), c("classes"), F.concat(near, far), v), F.transform(outline, lambda f: T.evidence_id("function", f["name"]))))
        finding = lambda d: F.concat(d["code"], F.lit(" at line "), d["line"].cast("string"), F.lit(": "), d["message"])
        shown = T.number_lines(F.slice("lines", v["start"].cast("int"), F.greatest(v["end"] - v["start"] + 1, F.lit(0)).cast("int")), v["start"])
        cut = lambda n, side: F.when(n > 0, F.concat(F.lit("# ... ["), n.cast("string"), F.lit(f" {side} lines omitted] ...")))
        parts = [
            F.concat(F.lit("Target: "), "path", F.lit(" ("), c("__total").cast("string"), F.lit(" lines)")), listed("Evidence (cite these only)", F.transform(ids, lambda i: F.concat(F.lit("- "), i))),
            F.concat(F.lit("### Failure\n"), "error"),
            listed("Traceback", F.concat(
                F.transform(target, lambda f: F.concat(F.lit("line "), f["line"].cast("string"), F.lit(" in "), f["function"], F.lit(": "), f["code"])),
                F.transform(external, lambda f: F.concat(F.lit("[external] line "), f["line"].cast("string"), F.lit(" in "), f["function"])),
            )),
            F.concat(F.lit("### Source\n"), T.wrap_untrusted(F.concat_ws("\n", cut(v["start"] - c("__first.start"), "earlier"), shown, cut(c("__first.end") - v["end"], "later")))),
            listed("Findings", F.transform(near, finding)), listed("Other findings", F.transform(far, finding)),
            listed("Outline", F.transform(outline, lambda f: F.concat(f["name"], F.lit(" lines "), f["start"].cast("string"), F.lit("-"), f["end"].cast("string")))),
        ]
        return F.struct(F.concat_ws("\n\n", *parts).alias("prompt"), ids.alias("manifest"), v["step"].alias("step"), v["start"].alias("start"), v["end"].alias("end"))

    names = F.array(*map(F.lit, STEPS))

    def fitting(v: Column) -> Column:
        """The rendered try if it fits, else null; what is rendered is bound, so each try is rendered once."""
        told = lambda m: F.struct(m["prompt"].alias("prompt"), m["manifest"].alias("manifest"), tokens(m["prompt"]).alias("tokens"), F.slice(names, F.lit(1), m["step"]).alias("omitted"), m["start"].alias("start"), m["end"].alias("end"))
        return F.get(F.filter(F.transform(F.transform(F.array(v), render), told), lambda x: x["tokens"] <= partition(budget)["prompt"]), F.lit(0))

    # A fold that renders no more once a try fits: tries after it are left alone.
    none = F.lit(None).cast("struct<prompt:string,manifest:array<string>,tokens:bigint,omitted:array<string>,start:bigint,end:bigint>")
    work = work.withColumn(out, F.aggregate("__tries", none, lambda found, v: F.when(found.isNotNull(), found).otherwise(fitting(v))))
    return work.drop(*[x for x in work.columns if x.startswith("__")])


def edit(source: Column, lines: Column, line: Column, findings: Column, budget: Column, tokens: Callable[[Column], Column] = T.estimate_tokens) -> Column:
    """Struct (prompt, tokens, omitted) for an edit proposal: the whole source, else of more than 30 lines those around the fault, else without findings."""
    total = F.size(lines).cast("long")
    around = excerpt(F.lit(None).cast("long"), F.lit(None).cast("long"), line, total)
    part = T.number_lines(F.slice(lines, around["start"].cast("int"), (around["end"] - around["start"] + 1).cast("int")), around["start"])
    whole = T.number_lines(lines, F.lit(1).cast("long"))
    narrow = F.when(total > 30, part).otherwise(whole)
    told = F.transform(F.slice(findings, 1, 5), lambda d: F.concat(d["code"], F.lit(" at line "), d["line"].cast("string")))
    out = []
    for body, with_findings, omitted in ((whole, True, ()), (narrow, True, ("distant_lines",)), (narrow, False, ("distant_lines", "findings"))):
        prompt = F.concat_ws("\n\n", F.concat(F.lit("### Source\n"), T.wrap_untrusted(body)), listed("Findings", told) if with_findings else F.lit(None).cast("string"))
        got = F.struct(prompt.alias("prompt"), tokens(prompt).alias("tokens"), F.array(*map(F.lit, omitted)).cast("array<string>").alias("omitted"))
        out.append(F.when(got["tokens"] <= budget, got))
    return F.coalesce(*out)
