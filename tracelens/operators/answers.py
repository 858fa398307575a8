"""Recorded answers of a model: validation, one correction, abstention, and the metrics of benchmark samples.

A call to a model is a row (sample, task, attempt, status, text): status is 'ok', or why there is no text. Nothing is called from here; whoever
records answers is the client, and ``Client`` joins what was recorded to what is asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import code, edits, matching

#: What a call that brings no text leads to.
FAILED_CALLS = {"unavailable": "MODEL_UNAVAILABLE", "timeout": "INFERENCE_TIMEOUT", "budget": "PROMPT_BUDGET_EXCEEDED"}
DIAGNOSIS = "bug_description string, root_cause string, confidence string, cited_evidence_ids array<string>, rationale string"
PROPOSAL = f"target_file string, edits array<{edits.EDIT}>, explanation string"


class Client:
    """Recorded answers in place of a model: ``ask`` gives each question its row, or status 'unavailable' where none was recorded."""

    def __init__(self, recorded: DataFrame):
        self.rows = recorded
        self.recorded = recorded.groupBy("sample", "task", "attempt").agg(F.min(F.struct("status", "text")).alias("__answer"))

    def ask(self, questions: DataFrame) -> DataFrame:
        """``questions`` (sample, task, attempt and others) with status and text."""
        found = questions.join(self.recorded, ["sample", "task", "attempt"], "left")
        return found.withColumns({"status": F.coalesce("__answer.status", F.lit("unavailable")), "text": F.col("__answer.text")}).drop("__answer")

    def attempts(self, samples: DataFrame, task: str) -> DataFrame:
        """``samples`` with the structs first and second (status, text) of two attempts at a task: one aggregate of what was recorded, one join."""
        at = lambda k: F.min(F.when(F.col("attempt") == k, F.struct("status", "text")))
        found = self.rows.filter(F.col("task") == task).groupBy("sample").agg(at(1).alias("__1"), at(2).alias("__2"))
        known = lambda c: F.struct(F.coalesce(F.col(c)["status"], F.lit("unavailable")).alias("status"), F.col(c)["text"].alias("text"))
        return samples.join(found, "sample", "left").withColumns({"first": known("__1"), "second": known("__2")}).drop("__1", "__2")


def failed_call(status: Column) -> Column:
    """Reason to abstain of a call that brought no text; null of one that did."""
    out = F.when(status == "ok", None)
    for name, reason in FAILED_CALLS.items():
        out = out.when(status == name, reason)
    return out.otherwise("MODEL_UNAVAILABLE")


def verdict(reason: Column, errors: Column) -> Column:
    """Struct (valid, reason, errors)."""
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), errors.alias("errors"))


def diagnosis(text: Column, manifest: Column, total_lines: Column) -> Column:
    """Struct (valid, reason, errors) of a diagnosis: its closed schema, then that it cites evidence and only such as the manifest holds (an
    empty manifest asks nothing), then that all lines it names, in citations or in prose, are lines of the file."""
    wrong = code.schema_errors(F.coalesce(text, F.lit("")), "diagnosis")
    a = F.from_json(text, DIAGNOSIS)
    cited = F.coalesce(a["cited_evidence_ids"], F.array().cast("array<string>"))
    unknown = F.when(F.size(manifest) > 0, matching.ungrounded_ids(cited, manifest)).otherwise(F.array().cast("array<string>"))
    named = F.concat(*[F.flatten(F.transform(F.array(*fields), find)) for fields, find in (((F.array_join(cited, " "),), T.evidence_lines), ((a["bug_description"], a["root_cause"], a["rationale"]), T.line_references))])
    outside = T.out_of_bounds(named, total_lines)
    none = F.array().cast("array<string>")
    tell = lambda title, xs: F.transform(xs, lambda x: F.concat(F.lit(title), x.cast("string")))
    reason = F.when(F.size(wrong) > 0, "SCHEMA_VALIDATION_FAILED").when((F.size(cited) == 0) | (F.size(unknown) > 0), "UNGROUNDED_EVIDENCE").when(F.size(outside) > 0, "OUT_OF_BOUNDS_LINES")
    errors = F.when(F.size(wrong) > 0, wrong).when(F.size(cited) == 0, F.array(F.lit("no evidence"))).when(F.size(unknown) > 0, tell("unknown evidence ", unknown)).otherwise(F.coalesce(tell("no line ", outside), none))
    return verdict(reason, errors)


def with_proposal(rows: DataFrame, text: Column, target: str, source: str, out: str) -> DataFrame:
    """Adds a struct (valid, reason, errors) of an edit proposal: its closed schema, then its edits by themselves and against the source, then that the
    edited source parses. What takes a parser is a column of its own, so that it is computed once."""
    rows = rows.withColumns({"__wrong": code.schema_errors(F.coalesce(text, F.lit("")), "edit_proposal"), "__a": F.from_json(text, PROPOSAL)})
    rows = rows.withColumn("__edits", F.coalesce("__a.edits", F.array().cast(f"array<{edits.EDIT}>")))
    rows = rows.withColumn("__applied", F.array_join(edits.apply_edits(F.col(source), F.col("__edits")), "\n"))
    rows = rows.withColumn("__syntax", code.syntax(F.col("__applied")))
    wrong, broken, a = F.col("__wrong"), F.col("__syntax").isNotNull(), F.col("__a")
    other = ~F.coalesce(edits.names_target(a["target_file"], F.col(target)), F.lit(False))
    bad = F.concat(edits.proposal_errors(F.coalesce(a["target_file"], F.lit("")), F.col("__edits")), F.array_compact(F.array(F.when(other, "other file"), F.when(F.col("__applied").isNull(), "expected text differs"))))
    rows = rows.withColumn("__bad", bad)
    bad = F.col("__bad")
    reason = F.when(F.size(wrong) > 0, "SCHEMA_VALIDATION_FAILED").when(F.size(bad) > 0, "OUT_OF_BOUNDS_LINES").when(broken, "SCHEMA_VALIDATION_FAILED")
    errors = F.when(F.size(wrong) > 0, wrong).when(F.size(bad) > 0, bad).when(broken, F.array(F.lit("edited source doesn't parse"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn(out, verdict(reason, errors)).drop("__wrong", "__a", "__edits", "__applied", "__syntax", "__bad")


def one_retry(status: Column, first: Column, again: Column, second: Column, keeps_first_reason: bool = False) -> Column:
    """Struct (outcome, reason, retried) of two attempts with their calls' statuses and verdicts.

    A first call that brings no text abstains at once. Otherwise an invalid answer is corrected once; if that call brings no text the first reason stays.
    A second invalid answer abstains with its own reason or, for edits that don't fit (``keeps_first_reason``), with the first one's.
    """
    lost, lost_again = failed_call(status), failed_call(F.coalesce(again, F.lit("unavailable")))
    own = F.coalesce(first["reason"], second["reason"]) if keeps_first_reason else second["reason"]
    own = F.when(second["reason"] == "SCHEMA_VALIDATION_FAILED", second["reason"]).otherwise(own)
    row = lambda outcome, reason, retried: F.struct(F.lit(outcome).alias("outcome"), reason.cast("string").alias("reason"), F.lit(retried).alias("retried"))
    return (
        F.when(lost.isNotNull(), row("abstains", lost, False)).when(first["valid"], row("valid", F.lit(None), False))
        .when(lost_again.isNotNull(), row("abstains", first["reason"], True)).when(second["valid"], row("valid after retry", F.lit(None), True)).otherwise(row("abstains", own, True))
    )


def diagnose(client: Client, samples: DataFrame) -> DataFrame:
    """Outcome of the diagnosis of each sample (sample, manifest, total_lines): outcome, reason, retried, whether the first answer cited unknown evidence, and the
    verdicts of both attempts."""
    both = client.attempts(samples.select("sample", "manifest", "total_lines"), "diagnosis")
    both = both.withColumns({f"v{k}": diagnosis(F.col(f"{k}.text"), F.col("manifest"), F.col("total_lines")) for k in ("first", "second")})
    cited = F.from_json("first.text", DIAGNOSIS)["cited_evidence_ids"]
    unknown = F.coalesce(F.exists(cited, lambda x: ~F.array_contains("manifest", x)), F.lit(False)) & (F.col("first.status") == "ok")
    return both.select("sample", one_retry(F.col("first.status"), F.col("vfirst"), F.col("second.status"), F.col("vsecond")).alias("o"), unknown.alias("hallucinated"), "vfirst", "vsecond").select("sample", "o.*", "hallucinated", "vfirst", "vsecond")


def propose(client: Client, samples: DataFrame) -> DataFrame:
    """The same of the edit proposals of samples (sample, target, source); changed: lines of the proposal that stands, 0 without one."""
    both = client.attempts(samples.select("sample", "target", "source"), "edit_proposal")
    for k in ("first", "second"):
        both = with_proposal(both, F.col(f"{k}.text"), "target", "source", f"v{k}")
    out = both.withColumn("o", one_retry(F.col("first.status"), F.col("vfirst"), F.col("second.status"), F.col("vsecond"), True))
    stands = F.when(F.col("o.outcome") == "valid", F.col("first.text")).when(F.col("o.outcome") == "valid after retry", F.col("second.text"))
    changed = F.coalesce(edits.changed_lines(F.from_json(stands, PROPOSAL)["edits"]), F.lit(0))
    return out.select("sample", "o.*", changed.cast("long").alias("changed"), "vfirst", "vsecond")


def sample_metrics(diagnoses: DataFrame, proposals: DataFrame, levels: DataFrame) -> DataFrame:
    """Benchmark metrics of each sample from the outcomes of ``diagnose`` and ``propose`` and its validation level (sample, level; null or none: no level).

    The first attempt counts if both tasks' first answers are valid. After the retry a diagnosis that stands counts, or a proposal that the retry saved. Levels include those
    below them; without a proposal there is none.
    """
    d = diagnoses.select("sample", F.col("outcome").alias("d"), "hallucinated")
    p = proposals.select("sample", F.col("outcome").alias("p"), "changed")
    both = d.join(p, "sample").join(levels.select("sample", "level"), "sample", "left")
    stands = F.col("p") != "abstains"
    has = lambda *ls: stands & F.coalesce(F.col("level").isin(*ls), F.lit(False))
    return both.select(
        "sample", ((F.col("d") == "valid") & (F.col("p") == "valid")).alias("first_valid"), ((F.col("d") != "abstains") | (F.col("p") == "valid after retry")).alias("post_valid"),
        ((F.col("d") != "valid") | (F.col("p") != "valid")).alias("retried"), stands.alias("precise"), "hallucinated", F.when(stands, F.col("changed")).otherwise(0).alias("diff_lines"),
        has("A", "B", "C", "D").alias("level_a"), has("B", "C", "D").alias("level_b"), has("C", "D").alias("level_c"), has("D").alias("level_d"),
    )
