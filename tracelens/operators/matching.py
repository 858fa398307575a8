"""Joins over evidence, diagnostics, intervals, calls and selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def ungrounded(cited: DataFrame, manifest: DataFrame, key: str | list[str]) -> DataFrame:
    """Citations that the manifest lacks, repeats kept."""
    return cited.join(manifest, key, "left_anti")


def ungrounded_ids(cited: Column, manifest: Column) -> Column:
    """The same for arrays of one record: repeats and order are kept."""
    return F.filter(cited, lambda x: ~F.array_contains(manifest, x))


BIN = 64  #: lines of a bin, by which spans of one file are dealt out


def bins(spans: DataFrame, start: str, end: str, name: str = "__bin") -> DataFrame:
    """A row for each bin of lines that a span touches; a span that ends before it starts touches none."""
    first, last = F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN)
    return spans.filter(F.col(end) >= F.col(start)).withColumn(name, F.explode(F.sequence(first, last)))


def innermost(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, point_key: str, ordinal: str) -> DataFrame:
    """Each point with the shortest span of its ``by`` that holds it, ties to the smaller ordinal; points without one keep nulls.

    The join has an equality on ``by`` and the bin of lines, so that a file with very many spans is dealt out; the choice is an aggregate that
    combines before it is shuffled.
    """
    held = bins(spans, start, end).select(F.col(by).alias("__by"), "__bin", F.struct((F.col(end) - F.col(start)).alias("size"), F.col(ordinal), F.col(start), F.col(end)).alias("__span"))
    near = points.withColumn("__at", F.floor(F.col(at) / BIN)).join(held, (F.col(by) == F.col("__by")) & (F.col("__at") == F.col("__bin")) & F.col(at).between(F.col(f"__span.{start}"), F.col(f"__span.{end}")))
    best = near.groupBy(point_key).agg(F.min("__span").alias("span"))
    return points.join(best, point_key, "left")


def overlapping(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Pairs of spans (start, end) of one ``by`` that share a line; right columns get a trailing underscore.

    Spans meet in bins of lines; a pair is given in the first bin that both touch. All pairs is what the join is for.
    """
    own = bins(left, "start", "end")
    other = bins(right.select(*[F.col(c).alias(f"{c}_") for c in right.columns]), "start_", "end_", "__bin_")
    first = F.floor(F.greatest("start", "start_") / BIN)
    joined = own.join(other, (F.col(by) == F.col(f"{by}_")) & (F.col("__bin") == F.col("__bin_")) & (F.col("start") <= F.col("end_")) & (F.col("end") >= F.col("start_")) & (F.col("__bin") == first))
    return joined.drop("__bin", "__bin_")


def diff_counts(baseline: DataFrame, candidate: DataFrame, key: list[str]) -> DataFrame:
    """pre_existing, eliminated and introduced findings of each key (file, code, mapped line), by counts.

    The last pass of matching pairs every leftover of equal code and line, so the counts need no pairing: the smaller count stays. Baseline rows with
    a null line (their line was edited) are all eliminated.
    """
    sides = baseline.select(*key, F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(candidate.select(*key, F.lit(0).alias("b"), F.lit(1).alias("c")))
    n = sides.groupBy(*key).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    mapped = F.col(key[-1]).isNotNull()
    pre = F.when(mapped, F.least("b", "c")).otherwise(0)
    return n.select(*key, pre.cast("long").alias("pre_existing"), (F.col("b") - pre).cast("long").alias("eliminated"), (F.col("c") - pre).cast("long").alias("introduced"))


def eliminated_findings(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(file, code, start_line, n) of baseline findings that are gone: baseline rows have start_line, and line, where it stands now (null if edited)."""
    base = baseline.groupBy("file", "code", "start_line", "line").agg(F.count(F.lit(1)).alias("b"))
    cand = candidate.groupBy("file", "code", "line").agg(F.count(F.lit(1)).alias("c"))
    kept = base.join(cand, ["file", "code", "line"], "left").withColumn("n", F.col("b") - F.least("b", F.coalesce("c", F.lit(0))))
    return kept.filter("n > 0").groupBy("file", "code", "start_line").agg(F.sum("n").alias("n"))


def targeted_eliminated(targets: DataFrame, baseline: DataFrame, candidate: DataFrame, parsed: DataFrame) -> DataFrame:
    """``targets`` (file, code, start_line or null) with ``ok``: a target with a line is gone if a finding of its code and line is; one by code alone if any
    of its code is gone or none is left. 'SyntaxError' by code alone is met where the baseline did not parse and the candidate does.

    ``parsed``: file, base_valid, valid. Null codes match nothing.
    """
    gone = eliminated_findings(baseline, candidate)
    exact = gone.select("file", "code", "start_line", F.lit(True).alias("__line")).distinct()
    some = gone.select("file", "code", F.lit(True).alias("__code")).distinct()
    left = candidate.select("file", "code", F.lit(True).alias("__left")).distinct()
    rows = targets.join(exact, ["file", "code", "start_line"], "left").join(some, ["file", "code"], "left").join(left, ["file", "code"], "left").join(parsed.select("file", "base_valid", "valid"), "file", "left")
    mended = (F.col("code") == "SyntaxError") & ~F.col("base_valid") & F.col("valid")
    by_code = F.coalesce(mended, F.lit(False)) | F.col("__code").isNotNull() | F.col("__left").isNull()
    return rows.withColumn("ok", F.when(F.col("start_line").isNotNull(), F.col("__line").isNotNull()).otherwise(by_code)).select(*targets.columns, "ok")


def level_a(parsed: DataFrame, baseline: DataFrame, candidate: DataFrame, targets: DataFrame) -> DataFrame:
    """Level A of each file of ``parsed`` (file, base_valid, valid): the candidate parses, no finding is new, and all targets are gone. A file without findings
    or targets needs only to parse. See ``targeted_eliminated``."""
    new = diff_counts(baseline, candidate, ["file", "code", "line"]).groupBy("file").agg(F.sum("introduced").alias("introduced"))
    met = targeted_eliminated(targets, baseline, candidate, parsed).groupBy("file").agg(F.bool_and("ok").alias("met"))
    out = parsed.select("file", "valid").join(new, "file", "left").join(met, "file", "left").withColumns({"introduced": F.coalesce("introduced", F.lit(0)), "targets_gone": F.coalesce("met", F.lit(True))})
    return out.select("file", (F.col("valid") & (F.col("introduced") == 0) & F.col("targets_gone")).alias("passed"), F.col("valid").alias("parses"), "introduced", "targets_gone")


def expected_vs_observed(manifest: DataFrame, observed: DataFrame, key: str, passed: Column) -> DataFrame:
    """Each manifest row with its observation and ``passed``; a sample that was not observed has not passed."""
    seen = observed.withColumn("__seen", F.lit(True))
    return manifest.join(seen, key, "left").withColumns({"observed": F.col("__seen").isNotNull(), "passed": F.coalesce(passed & F.col("__seen"), F.lit(False))}).drop("__seen")


def costs_of(calls: DataFrame, kind: str, name: str, costs: DataFrame) -> DataFrame:
    """Calls with time, aux_space, amortized and expected of the cost dimension (kind, name, ...), nulls of calls that it lacks. The dimension has
    some 55 rows, whatever the calls."""
    dim = costs.select(F.col("kind").alias("__kind"), F.col("name").alias("__name"), "time", "aux_space", "amortized", "expected")
    return calls.join(F.broadcast(dim), (F.col(kind) == F.col("__kind")) & (F.col(name) == F.col("__name")), "left").drop("__kind", "__name")


def unknown_calls(calls: DataFrame, known: DataFrame, by: str, ordinal: str, name: str) -> DataFrame:
    """The first call, in walk order, of each function that no cost table knows and that is no call of itself."""
    missing = calls.filter(F.col(name) != F.col(by)).join(known, name, "left_anti")
    return missing.groupBy(by).agg(F.min_by(name, ordinal).alias("first_unknown"))


def call_edges(structure: DataFrame, key: str) -> DataFrame:
    """(key, on_self, caller, callee) of the calls in structure rows: by plain name between functions, by ``self.`` or ``cls.`` between methods."""
    method = F.regexp_extract("label", r"^(?:self|cls)\.([^.]+)$", 1)
    rows = structure.filter("kind = 'call'").select(key, (method != "").alias("on_self"), F.element_at(F.split("function", r"\."), -1).alias("caller"), F.when(method != "", method).otherwise(F.col("label")).alias("callee"), F.col("function").contains(".").alias("in_class"))
    return rows.filter("callee <> '' and not contains(callee, '.') and on_self = in_class").select(key, "on_self", "caller", "callee").distinct()


def mutual_calls(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Edges (caller, callee) whose reverse is there too, self calls aside; with ``by``, within each group of those columns."""
    by = by or []
    back = edges.select(*by, F.col("callee").alias("caller"), F.col("caller").alias("callee")).distinct()
    return edges.filter("caller <> callee").distinct().join(back, [*by, "caller", "callee"], "left_semi")


def resolve_selectors(selectors: DataFrame, functions: DataFrame, path: str | None = None) -> DataFrame:
    """Selectors (id, file, class_name, function) against functions (file, ordinal, name, qualified_name, is_method): adds
    ``matched`` (qualified name) and ``problem`` ('not found', 'ambiguous').

    ``path``: column of the path that a selector itself names, null of none; its last part must be the file's, whatever the case. A class selects the exact qualified name; without one a top-level function comes first, else the only method of that name. Functions are
    first reduced to a row for each (file, name) and (file, qualified name), so neither join multiplies selectors.
    """
    by_name = functions.groupBy(F.col("file").alias("__file"), F.col("name").alias("__name")).agg(
        F.min_by("qualified_name", F.when(~F.col("is_method"), F.col("ordinal"))).alias("top"), F.min_by("qualified_name", F.when(F.col("is_method"), F.col("ordinal"))).alias("method"),
        F.count_if("is_method").alias("methods"),
    )
    by_path = functions.select(F.col("file").alias("__file2"), F.col("qualified_name").alias("exact")).distinct()
    free = F.col("class_name").isNull()
    wanted = F.when(~free, F.concat_ws(".", "class_name", "function"))
    here = F.coalesce(F.lower(T.basename(path)) == F.lower(T.basename("file")), F.lit(True)) if path else F.lit(True)
    selectors = selectors.withColumn("__here", here)
    both = selectors.join(by_name, F.col("__here") & free & (F.col("file") == F.col("__file")) & (F.col("function") == F.col("__name")), "left")
    both = both.join(by_path, F.col("__here") & (F.col("file") == F.col("__file2")) & (wanted == F.col("exact")), "left")
    matched = F.coalesce("exact", "top", F.when(F.col("methods") == 1, F.col("method")))
    problem = F.when(matched.isNotNull(), None).when(F.col("methods") > 1, "ambiguous").otherwise("not found")
    return both.select("id", matched.alias("matched"), problem.alias("problem"))


def nested_prefixes(selectors: DataFrame, functions: DataFrame) -> DataFrame:
    """Selectors (id, file, class_name) some prefix of whose class path names a function: those reach into a function, which is not supported."""
    parts = F.split("class_name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    rows = selectors.filter("class_name is not null").select("id", "file", F.explode(prefixes).alias("qualified_name"))
    return rows.join(functions.select("file", "qualified_name").distinct(), ["file", "qualified_name"], "left_semi").select("id").distinct()


def first_mismatch(expected: Column, actual: Column) -> Column:
    """Index (from 0) of the first unequal pair of two arrays; null if all are equal. A missing element is unequal."""
    same = F.zip_with(expected, actual, lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).cast("long")
