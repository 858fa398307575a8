"""Record types of the engine as Spark DDL, and the closed vocabularies of their columns (fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CONFIDENCE = ("HIGH", "MEDIUM", "LOW")
SEVERITY = ("error", "warning", "info")
LEVELS = ("NONE", "A", "B", "C", "D")
DETECTION = ("CERTAIN", "PROBABLE", "UNSUPPORTED")
COMPLEXITY_ABSTENTION = ("UNKNOWN_CALL", "DYNAMIC_BOUNDS", "DYNAMIC_RECURSION", "EXTERNAL_DEPENDENCY", "UNSUPPORTED_SYNTAX")
DIAGNOSIS_ABSTENTION = (
    "SCHEMA_VALIDATION_FAILED", "UNGROUNDED_EVIDENCE", "OUT_OF_BOUNDS_LINES", "MALFORMED_JSON", "MODEL_UNAVAILABLE", "INFERENCE_TIMEOUT", "PROMPT_BUDGET_EXCEEDED", "EMPTY_RESPONSE",
)
OPERATIONS = ("replace", "insert", "delete")

SIGNATURE = "struct<exception_type:string,normalized_message:string,top_target_file:string,top_target_line:bigint>"
FRAME = "struct<file_path:string,line_number:bigint,function_name:string,code_line:string,is_target:boolean>"
EDIT = "struct<operation:string,start_line:bigint,end_line:bigint,expected_text:string,replacement_text:string>"

#: DDL of each table; order is significant in arrays.
TABLES = {
    "targets": "path string, absolute_path string, file_size_bytes bigint, sha256 string, encoding string, has_bom boolean, newline_style string, has_trailing_newline boolean, is_read_only boolean, is_reparse_point boolean",
    "detections": "path string, language string, confidence string, reasons array<string>, matched_extension string, has_shebang boolean",
    "diagnostics": "path string, source string, code string, message string, severity string, start_line bigint, start_col bigint, end_line bigint, end_col bigint, fix_available boolean",
    "frames": "run_id bigint, file_path string, line_number bigint, function_name string, code_line string, is_target boolean",
    "signatures": "run_id bigint, exception_type string, normalized_message string, top_target_file string, top_target_line bigint",
    "runs": f"run_id bigint, path string, exit_code int, stdout string, stderr string, duration_seconds double, timed_out boolean, output_truncated boolean, peak_rss_bytes bigint, error_signature {SIGNATURE}, frames array<{FRAME}>",
    "functions": "path string, name string, qualified_name string, start_line bigint, end_line bigint, parameters array<string>, is_async boolean, is_method boolean, docstring string",
    "classes": "path string, name string, start_line bigint, end_line bigint, methods array<string>",
    "diagnoses": "path string, bug_description string, root_cause string, confidence string, cited_evidence_ids array<string>, rationale string",
    "abstentions": "target string, reason string, details string, raw_payload string, validation_errors array<string>, retry_attempted boolean",
    "proposals": f"target_file string, edits array<{EDIT}>, explanation string",
    "validations": f"level_achieved string, static_valid boolean, failure_reproduction_removed boolean, clean_execution boolean, behavioral_oracle_passed boolean, baseline_error_signature {SIGNATURE}, candidate_error_signature {SIGNATURE}, details map<string,string>",
    "complexity": "target string, time_complexity string, auxiliary_space string, output_space string, confidence string, is_amortized boolean, is_expected boolean, assumptions array<string>, abstention_reason string, details string, start_line bigint, end_line bigint",
    "profiles": "target string, import_duration_ms double, import_stdout string, import_stderr string, warmup_invocations bigint, measured_invocations bigint, median_latency_ms double, mean_latency_ms double, min_latency_ms double, max_latency_ms double, dispersion_ms double, python_allocations_tracemalloc_bytes bigint, approximate_process_tree_rss_bytes bigint, hot_process_reused boolean",
    "inference": "context_window_tokens bigint, prompt_budget_tokens bigint, output_budget_tokens bigint, application_safety_margin_tokens bigint, estimated_prompt_tokens bigint, prompt_eval_count bigint, eval_count bigint, prompt_eval_duration_ms double, eval_duration_ms double, was_truncated boolean, omitted_evidence_categories array<string>",
    "pairs": "id string, task_type string, category string, target_file string, source_code string, prompt string, completion string, messages array<struct<role:string,content:string>>, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, evidence_manifest array<string>, metadata map<string,string>",
    "sample_results": "suite string, id string, category string, passed boolean, duration_ms double, peak_rss_bytes bigint, schema_valid boolean",
    "envelopes": "schema_version string, command string, success boolean, target_path string, data variant, errors array<string>, limitations array<string>, metadata map<string,string>",
}

#: Predicates that rows of a table satisfy.
CHECKS = {
    "diagnostics": "start_line >= 1 and start_col >= 1 and (end_line > start_line or end_line = start_line and end_col >= start_col)",
    "inference": "prompt_budget_tokens + output_budget_tokens + application_safety_margin_tokens = context_window_tokens",
    "envelopes": "schema_version = '1.0'",
    "pairs": "prompt_tokens + completion_tokens = total_tokens",
    "functions": "1 <= start_line and start_line <= end_line",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def holds(table: str) -> Column:
    """Whether a row passes its table's check; true where the table has none."""
    return F.coalesce(F.expr(CHECKS.get(table, "true")), F.lit(False))
