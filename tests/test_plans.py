"""Plans of the registered queries: what is read, and which joins are left to nested loops."""

import os
import re

import pytest

from tracelens.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")

#: Queries that join a single row (a range's ends, a manifest's parts, whether there is any row at all).
SINGLE_ROW = {"p01_category_or_first", "p01_category_present", "s10_manifest"}
#: Queries whose work needs a parser or order-dependent matching.
PYTHON = {"d01_syntax", "d02_definitions", "d03_structure", "d04_input_needs", "d05_complexity", "d13_evidence", "f05_encodings", "f12_glyph_fallback", "f18_language", "f25_unified_diff", "f31_strict_schema",
          "j02_diff_pairs", "s01_target_facts", "s01_scanned_files", "s02_decoded_text", "s03_decoded_with_fallback", "x01_table_function",
          "a14_loops_and_recursion", "f36_syntax_positions", "d06_all_functions", "d07_recursion", "d08_halving_loops", "d09_container_kinds", "d10_nested_loops", "d11_spaces", "d12_confidence",
          "d16_level_a_of_programs", "x06_resolved_functions", "d20_retries", "d20_proposal_retries", "d21_sample_metrics", "j12_mutual_methods"}
WRITES = {"s05_first_valid_lines", "t03_ended_runs", "a01_kept_up_to_date", "a08_kept_up_to_date", "s16_recorded_answers", "s17_recorded_runs", "s09_committed_splits", "s15_manifest", "s15_complexity_manifest", "s04_json_items", "s05_json_lines", "s06_split_union", "s09_split_files", "t03_stream_summary"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - WRITES))
def test_joins_and_python(spark, name):
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert ("NestedLoop" in plan) <= (name in SINGLE_ROW)
    assert bool(re.search("EvalPython|MapInArrow|InPandas", plan)) == (name in PYTHON)


def test_pruning_and_pushdown(spark):
    plan = lambda name: catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan("w02_first_per_group")
    assert "EqualTo(event_type,error)" in plan("o05_first_errors") and "props" not in plan("a01_suite_summary")
    assert "WindowGroupLimit" in plan("w02_first_per_group") and "TakeOrderedAndProject" in plan("o06_first_samples")
