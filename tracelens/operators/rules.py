"""Predicates and projections over recorded runs, samples and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

ENVELOPE_KEYS = ("schema_version", "command", "success", "target_path", "data", "errors", "limitations")
#: Environment variables that a run keeps (fixed values).
ENV_ALLOWED = ("SYSTEMROOT", "SYSTEMDRIVE", "PATH", "PATHEXT", "TEMP", "TMP", "COMSPEC", "USERNAME")
MOST_PROMPT, MOST_COMPLETION, MOST_TOTAL = 1200, 600, 2048


def only_external(exit_code: Column, frames: Column) -> Column:
    """A failed run whose frames are all outside the target, some there: nothing to diagnose."""
    return (exit_code != 0) & (F.size(frames) > 0) & ~F.exists(frames, lambda f: f["is_target"])


def is_defect(syntax_valid: Column, findings: Column, exit_code: Column, oracle_ok: Column) -> Column:
    """Any of: a syntax error, findings, a failing run, an oracle that is there and not met."""
    return ~syntax_valid | (findings > 0) | (F.coalesce(exit_code, F.lit(0)) != 0) | ~F.coalesce(oracle_ok, F.lit(True))


def unix_ends(x: Column) -> Column:
    return F.replace(x, F.lit("\r\n"), F.lit("\n"))


def oracle_met(exit_code: Column, timed_out: Column, stdout: Column, want_exit: Column, want_stdout: Column, want_part: Column) -> Column:
    """Whether a run does what is expected: exit code (0 unless stated), no timeout, whole output (raw, with LF ends, or stripped), part of
    the output (raw or with LF ends). Null expectations ask nothing; null if there is none at all."""
    same = (stdout == want_stdout) | (unix_ends(stdout) == unix_ends(want_stdout)) | (strip(stdout) == strip(want_stdout))
    part = stdout.contains(want_part) | unix_ends(stdout).contains(unix_ends(want_part))
    asked = want_exit.isNotNull() | want_stdout.isNotNull() | want_part.isNotNull()
    met = (exit_code == F.coalesce(want_exit, F.lit(0))) & ~timed_out & F.coalesce(same, F.lit(True)) & F.coalesce(part, F.lit(True))
    return F.when(asked, met)


def is_envelope(text: Column, command: Column) -> Column:
    """Whether a JSON text has all keys of an envelope and names the command."""
    keys = F.json_object_keys(text)
    return F.coalesce((F.size(F.array_except(F.array(*map(F.lit, ENVELOPE_KEYS)), keys)) == 0) & (F.get_json_object(text, "$.command") == command), F.lit(False))


def bug_passed(category: Column, expected: Column, exit_code: Column, success: Column, syntax_valid: Column, timed_out: Column, truncated: Column) -> Column:
    """Verdict on a sample of the bug suite. Any failing exit passes where an exception, assertion or import error is expected."""
    static = F.when(expected == "syntax_error", ~(syntax_valid & success) & (exit_code != 0)).otherwise(syntax_valid & (exit_code == 0))
    run = (
        F.when(expected == "clean_success", (exit_code == 0) & success).when(expected == "timeout", (exit_code == 4) | timed_out)
        .when(expected == "output_overflow", truncated | (exit_code != 0)).when(expected.isin("runtime_exception", "assertion_failure", "import_error"), exit_code != 0).otherwise(True)
    )
    return F.when(category == "syntax_error", static).otherwise(run)


def complexity_passed(should_abstain: Column, expected: Column, inferred: Column, reason: Column, exit_code: Column) -> Column:
    from ..functions.text import normalize_exponents

    abstains = reason.isNotNull() | (exit_code != 0) | F.coalesce(inferred == "UNKNOWN", F.lit(False))
    return F.when(should_abstain, abstains).otherwise(normalize_exponents(inferred).eqNullSafe(normalize_exponents(expected)) & (exit_code == 0))


def profile_passed(expected_success: Column, exit_code: Column, success: Column, reused: Column, mean: Column) -> Column:
    return F.when(expected_success, (exit_code == 0) & success & reused & (mean > 0)).otherwise((exit_code != 0) & ~success)


def boundary_passed(category: Column, exit_code: Column, success: Column, confidence: Column, parsed: Column) -> Column:
    info = category.isin("encodings", "line_endings", "filenames", "permissions", "filesystem")
    return F.when(category == "detection", (exit_code == 0) & confidence.isNotNull()).when(info, (exit_code == 0) & success).when(category == "processes", parsed).otherwise(True)


def category_or_first(rows: DataFrame, own: Column, order: str, first: int) -> DataFrame:
    """The rows of a category; where it has none, the first rows by order. Both branches stop early: one row tells whether there is any."""
    mine = rows.filter(own)
    some = mine.limit(1).select(F.lit(1).alias("__one"))
    return mine.unionByName(rows.orderBy(order).limit(first).join(some, F.lit(True), "left_anti"))


def pair_errors(prompt: Column, completion: Column, total: Column, counted_prompt: Column, counted_completion: Column, roles: Column) -> Column:
    """Array of what is wrong with an instruction pair's token counts and messages."""
    names = ("system", "user", "assistant")
    order = [F.when((F.size(roles) == 3) & ~F.get(roles, F.lit(i)).eqNullSafe(F.lit(r)), f"message {i} is not {r}") for i, r in enumerate(names)]
    return F.array_compact(F.array(
        F.when(prompt > MOST_PROMPT, "prompt too long"), F.when(completion > MOST_COMPLETION, "completion too long"), F.when(total > MOST_TOTAL, "context too long"),
        F.when(prompt + completion != total, "token sum"), F.when(F.abs(counted_prompt - prompt) > 2, "prompt count"), F.when(F.abs(counted_completion - completion) > 2, "completion count"),
        F.when(F.size(roles) != 3, "not three messages"), *order,
    ))


def allowed_env(env: Column) -> Column:
    """Variables on the allow list, by upper-case name; PYTHON overrides never pass."""
    return F.map_filter(env, lambda k, _: F.upper(k).isin(*ENV_ALLOWED) & ~F.upper(k).startswith("PYTHON"))


def exit_code(outcome: Column) -> Column:
    """Exit code of a command's outcome: success, target_failure, usage, target_io, timeout, inference, abstention are 0 to 6."""
    out = None
    for code, name in enumerate(("success", "target_failure", "usage", "target_io", "timeout", "inference", "abstention")):
        out = F.when(outcome == name, code) if out is None else out.when(outcome == name, code)
    return out.cast("long")


def report(import_ns: Column, mean_ns: Column, peak_bytes: Column) -> Column:
    """Profile report: milliseconds of nanoseconds, and the greatest heap."""
    return F.struct((import_ns / 1e6).alias("import_ms"), (mean_ns / 1e6).alias("mean_ms"), peak_bytes.alias("heap_bytes"))


def level(passes_a: Column, failure_gone: Column, clean: Column, oracle_ok: Column) -> Column:
    """Highest validation level reached: D needs the oracle and C, C a clean run, B the failure gone, A is a must for all; null without A."""
    return F.when(~passes_a, None).when(clean & F.coalesce(oracle_ok, F.lit(False)), "D").when(clean, "C").when(failure_gone, "B").otherwise("A")


def failure_gone(base_exit: Column, base_sig: Column, cand_exit: Column, timed_out: Column, same: Column) -> Column:
    """Whether a candidate run no longer shows the baseline's failure. A timeout never does; a clean run always; else another signature than the
    baseline's, or where that has none another exit code than its failing one."""
    return (
        F.when(timed_out, False).when(cand_exit == 0, True).when(base_sig.isNotNull(), ~same)
        .when(F.coalesce(base_exit, F.lit(0)) != 0, cand_exit != base_exit).otherwise(False)
    )


def signature(timed_out: Column, exit_code: Column, parsed: Column, limit: Column) -> Column:
    """Error signature of a run: the traceback's, else one made up of a timeout or a failing exit; null of a clean run."""
    made = lambda t, m: F.struct(F.lit(t).alias("type"), m.alias("message"), F.lit(None).cast("string").alias("file"))
    late = F.concat(F.lit("Execution exceeded timeout limit ("), F.format_string("%.1f", limit.cast("double")), F.lit("s)."))
    failed = F.concat(F.lit("Process exited with non-zero code "), exit_code.cast("string"), F.lit("."))
    return F.when(parsed.isNotNull(), parsed).when(timed_out, made("TimeoutExpired", late)).when(exit_code != 0, made("SystemExit", failed))


def synced(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Struct of two fields that name one thing: each takes the other's value where it has none."""
    return F.struct(F.coalesce(a, b).alias(names[0]), F.coalesce(b, a).alias(names[1]))
