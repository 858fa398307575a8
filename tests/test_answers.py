"""Recorded answers, levels and calls: cases that the generated rows lack."""

import json

from pyspark.sql import functions as F

from tracelens.operators import answers, code, matching

GOOD = {"bug_description": "b", "root_cause": "r", "confidence": "HIGH", "cited_evidence_ids": ["runtime:X"], "rationale": "at line 2"}
KIND = "sample long, task string, attempt int, status string, text string"


def outcomes(spark, rows, manifest=("runtime:X", "traceback:line_2"), total=3):
    recorded = [(s, "diagnosis", k, status, json.dumps(GOOD | t) if isinstance(t, dict) else t) for s, k, status, t in rows]
    samples = spark.createDataFrame([(s, list(manifest), total) for s in sorted({r[0] for r in rows})], "sample long, manifest array<string>, total_lines long")
    found = answers.diagnose(answers.Client(spark.createDataFrame(recorded, KIND)), samples)
    return {r.sample: (r.outcome, r.reason, r.retried, r.hallucinated) for r in found.collect()}


def test_diagnoses(spark):
    bad_line, other = {"rationale": "see lines 2-9"}, {"cited_evidence_ids": ["runtime:X", "ruff:E1:line_1"]}
    got = outcomes(spark, [
        (1, 1, "ok", {}), (2, 1, "ok", bad_line), (2, 2, "ok", {}), (3, 1, "ok", bad_line), (4, 1, "ok", bad_line), (4, 2, "timeout", None), (5, 1, "ok", bad_line), (5, 2, "ok", other),
        (6, 1, "ok", other), (6, 2, "ok", "{"), (7, 1, "timeout", None), (7, 2, "ok", {}), (8, 1, "budget", None), (9, 1, "odd", None), (10, 1, "ok", None), (10, 2, "ok", {}), (11, 2, "ok", {}),
        (12, 1, "ok", {}), (12, 1, "ok", {}), (13, 1, "ok", {"cited_evidence_ids": ["traceback:line_2"]}), (14, 1, "ok", {"cited_evidence_ids": []}), (14, 2, "ok", {}),
    ])
    assert got == {
        1: ("valid", None, False, False), 2: ("valid after retry", None, True, False), 3: ("abstains", "OUT_OF_BOUNDS_LINES", True, False), 4: ("abstains", "OUT_OF_BOUNDS_LINES", True, False),
        5: ("abstains", "UNGROUNDED_EVIDENCE", True, False), 6: ("abstains", "SCHEMA_VALIDATION_FAILED", True, True), 7: ("abstains", "INFERENCE_TIMEOUT", False, False), 8: ("abstains", "PROMPT_BUDGET_EXCEEDED", False, False),
        9: ("abstains", "MODEL_UNAVAILABLE", False, False), 10: ("valid after retry", None, True, False), 11: ("abstains", "MODEL_UNAVAILABLE", False, False), 12: ("valid", None, False, False), 13: ("valid", None, False, False),
        14: ("valid after retry", None, True, False),
    }
    # an empty manifest asks for some evidence, of any name; a file of no lines has no bounds
    assert outcomes(spark, [(1, 1, "ok", {"cited_evidence_ids": ["anything"], "rationale": "line 900"})], manifest=(), total=0)[1][0] == "valid"


def test_proposals_keep_the_first_reason(spark):
    source = "def f(x):\n    return x\n"
    edit = lambda old, new, **more: json.dumps({"target_file": "a.py", "edits": [{"operation": "replace", "start_line": 2, "end_line": 2, "expected_text": old, "replacement_text": new}], "explanation": "e"} | more)
    good, wrong, broken = edit("    return x", "    return 2 * x\n    # twice"), edit("    return y", "    return x"), edit("    return x", "    return (")
    rows = [(1, 1, good), (2, 1, wrong), (2, 2, good), (3, 1, broken), (3, 2, wrong), (4, 1, wrong), (4, 2, broken), (5, 1, "[]"), (5, 2, wrong), (6, 1, edit("    return x", "    return x", target_file="../a.py")), (6, 2, good)]
    recorded = spark.createDataFrame([(s, "edit_proposal", k, "ok", t) for s, k, t in rows], KIND)
    samples = spark.createDataFrame([(s, "a.py", source) for s in range(1, 8)], "sample long, target string, source string")
    got = {r.sample: (r.outcome, r.reason, r.retried, r.changed) for r in answers.propose(answers.Client(recorded), samples).collect()}
    bounds, schema = "OUT_OF_BOUNDS_LINES", "SCHEMA_VALIDATION_FAILED"
    assert got == {
        1: ("valid", None, False, 2), 2: ("valid after retry", None, True, 2), 3: ("abstains", schema, True, 0), 4: ("abstains", schema, True, 0), 5: ("abstains", schema, True, 0),
        6: ("valid after retry", None, True, 2), 7: ("abstains", "MODEL_UNAVAILABLE", False, 0),
    }
    empty = spark.createDataFrame([], KIND)
    assert answers.propose(answers.Client(empty), samples.limit(0)).collect() == [] and answers.diagnose(answers.Client(empty), spark.createDataFrame([], "sample long, manifest array<string>, total_lines long")).collect() == []


def test_level_a(spark):
    """Line 3 of the baseline was edited (no line now); targets by line count in the baseline's lines."""
    finding = "file long, code string, start_line long, line long"
    base = spark.createDataFrame([(1, "E", 3, None), (1, "W", 5, 4), (1, "W", 5, 4), (2, "E", 1, 1), (3, "E", 1, 1)], finding)
    cand = spark.createDataFrame([(1, "W", 4), (2, "E", 1), (2, "E", 1), (3, "E", 1)], "file long, code string, line long")
    parsed = spark.createDataFrame([(1, True, True), (2, True, True), (3, True, True), (4, False, True), (5, False, False), (6, True, True)], "file long, base_valid boolean, valid boolean")
    targets = spark.createDataFrame([(1, "E", 3), (1, "W", 5), (1, "W", None), (3, "E", 1), (3, "X", None), (4, "SyntaxError", None), (4, "E", 7)], "file long, code string, start_line long")
    met = {(r.file, r.code, r.start_line): r.ok for r in matching.targeted_eliminated(targets, base, cand, parsed).collect()}
    assert met == {(1, "E", 3): True, (1, "W", 5): True, (1, "W", None): True, (3, "E", 1): False, (3, "X", None): True, (4, "SyntaxError", None): True, (4, "E", 7): False}
    got = {r.file: (r.passed, r.parses, r.introduced, r.targets_gone) for r in matching.level_a(parsed, base, cand, targets).collect()}
    assert got == {1: (True, True, 0, True), 2: (False, True, 1, True), 3: (False, True, 0, False), 4: (False, True, 0, False), 5: (False, False, 0, True), 6: (True, True, 0, True)}


def test_calls_both_ways(spark):
    source = "def a():\n    b()\n    a()\n\n\ndef b():\n    a()\n\n\nclass C:\n    def a(self):\n        self.b()\n        b()\n\n    def b(self):\n        cls.a()\n\n\ndef c():\n    self.a()\n"
    files = spark.createDataFrame([(1, source), (2, "def a():\n    b()\n"), (3, None)], "k long, s string")
    edges = matching.call_edges(code.structure(files, "k", "s"), "k")
    assert sorted(map(tuple, matching.mutual_calls(edges, ["k", "on_self"]).collect())) == [(1, False, "a", "b"), (1, False, "b", "a"), (1, True, "a", "b"), (1, True, "b", "a")]


def test_observations_that_are_missing(spark):
    manifest, runs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long"), spark.createDataFrame([(1, 0), (2, 1), (9, 0)], "id long, code int")
    got = matching.expected_vs_observed(manifest, runs, "id", F.col("code") == 0).collect()
    assert sorted((str(r.id), r.observed, r.passed) for r in got) == [("1", True, True), ("2", True, False), ("3", False, False), ("None", False, False)]
