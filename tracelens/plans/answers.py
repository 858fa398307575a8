"""Recorded answers and runs, validation of repairs, and what joins them to manifests, by role mapping over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import costs
from ..functions import text as T
from ..operators import answers, code, context, matching, registry, rules, stats, windows
from ..sources import files
from .programs import SQL_FIRST, SQL_LAST, SQL_PROGRAMS, docs, literal, of_forms, programs, scratch, sql_prompt
from .relational import edited, events, findings, frames
from .registry import query, table
from .scalars import SQL_LINES


# --- answers --------------------------------------------------------------------------------------


def answer(cites, rationale):
    fields = [("bug_description", F.lit("b")), ("root_cause", F.concat(F.lit("in "), "source")), ("confidence", F.lit("HIGH")), ("cited_evidence_ids", cites), ("rationale", rationale)]
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields]))


def recorded(spark, sf):
    """Two attempts at a diagnosis of each document; no text was recorded of a quarter of the second ones."""
    d, n = docs(spark, sf), F.col("doc_id")
    none, own = F.array().cast("array<string>"), F.array(F.concat(F.lit("runtime:"), "source"))
    good = answer(own, F.lit("See line 1."))
    first = [good, answer(own, F.concat(F.lit("See lines 1 to "), (n % 40 + 1).cast("string"))), answer(F.array(F.lit("runtime:other")), F.lit("r")), answer(none, F.lit("r")), F.lit("{oops"), F.lit(None).cast("string"),
             F.regexp_replace(good, r"\}$", ', "extra": 1}')]
    second = [good, answer(F.array(F.lit("runtime:other"), F.lit("x")), F.lit("r")), F.lit("not JSON")]
    status = F.when(n % 7 == 5, "timeout").otherwise("ok")
    text = F.get(F.array(*second), (F.floor(n / 7) % 4).cast("int"))
    tries = [(1, status, F.get(F.array(*first), (n % 7).cast("int"))), (2, F.when(text.isNull(), "unavailable").otherwise("ok"), text)]
    return d.select(n.alias("sample"), F.lit("diagnosis").alias("task"), F.inline(F.array(*[F.struct(F.lit(k).alias("attempt"), s.alias("status"), t.alias("text")) for k, s, t in tries])))


SQL_DIAGNOSES = f"""
WITH l AS (SELECT doc_id, doc_id % 7 AS f, doc_id // 7 % 4 AS g, len({SQL_LINES}) AS n FROM documents),
v AS (SELECT *, CASE WHEN f = 1 AND n > 0 AND doc_id % 40 + 1 > n THEN 'OUT_OF_BOUNDS_LINES' WHEN f IN (2, 3) THEN 'UNGROUNDED_EVIDENCE' WHEN f IN (4, 6) THEN 'SCHEMA_VALIDATION_FAILED' END AS r FROM l)
SELECT doc_id AS sample, CASE WHEN f = 5 THEN 'abstains' WHEN r IS NULL THEN 'valid' WHEN g = 0 THEN 'valid after retry' ELSE 'abstains' END AS outcome,
  CASE WHEN f = 5 THEN 'INFERENCE_TIMEOUT' WHEN r IS NULL OR g = 0 THEN NULL WHEN g = 3 THEN r WHEN g = 1 THEN 'UNGROUNDED_EVIDENCE' ELSE 'SCHEMA_VALIDATION_FAILED' END AS reason,
  f <> 5 AND r IS NOT NULL AS retried, f = 2 AS hallucinated FROM v"""


def diagnoses(spark, sf):
    samples = docs(spark, sf).select(F.col("doc_id").alias("sample"), F.array(F.concat(F.lit("runtime:"), "source"), F.lit("traceback:line_1")).alias("manifest"), T.line_count("text").alias("total_lines"))
    return answers.diagnose(answers.Client(recorded(spark, sf)), samples).select("sample", "outcome", "reason", "retried", "hallucinated")


@query("d20_retries", SQL_DIAGNOSES)
def d20(spark, sf):
    return diagnoses(spark, sf)


def proposed(spark, sf):
    """Two attempts at a repair of each generated program."""
    p, n = programs(spark, sf), F.col("doc_id")
    edit = lambda old, new: F.struct(F.lit("replace").alias("operation"), F.col("fault_line").alias("start_line"), F.col("fault_line").alias("end_line"), old.alias("expected_text"), new.alias("replacement_text"))
    made = lambda target, old, new: F.to_json(F.struct(target.alias("target_file"), F.array(edit(old, new)).alias("edits"), F.lit("e").alias("explanation")))
    target, faulty, fixed = F.col("target_file"), F.col("faulty"), F.col("fixed")
    good, wrong = made(target, faulty, fixed), made(target, F.lit("no such line"), fixed)
    first = [good, wrong, made(F.lit("other.py"), faulty, fixed), F.lit("[]"), made(target, faulty, F.lit("def (:"))]
    second = [good, wrong, F.lit("not JSON")]
    tries = [(1, F.get(F.array(*first), (n % 5).cast("int"))), (2, F.get(F.array(*second), (F.floor(n / 5) % 3).cast("int")))]
    return p.select(n.alias("sample"), F.lit("edit_proposal").alias("task"), F.inline(F.array(*[F.struct(F.lit(k).alias("attempt"), F.lit("ok").alias("status"), t.alias("text")) for k, t in tries])))


def proposals(spark, sf):
    samples = programs(spark, sf).select(F.col("doc_id").alias("sample"), F.col("target_file").alias("target"), F.col("source_code").alias("source"))
    return answers.propose(answers.Client(proposed(spark, sf)), samples).select("sample", "outcome", "reason", "retried", "changed")


SQL_PROPOSALS = """
WITH v AS (SELECT doc_id, doc_id // 5 % 3 AS g, CASE WHEN doc_id % 5 IN (1, 2) THEN 'OUT_OF_BOUNDS_LINES' WHEN doc_id % 5 IN (3, 4) THEN 'SCHEMA_VALIDATION_FAILED' END AS r FROM documents)
SELECT doc_id AS sample, CASE WHEN r IS NULL THEN 'valid' WHEN g = 0 THEN 'valid after retry' ELSE 'abstains' END AS outcome,
  CASE WHEN r IS NULL OR g = 0 THEN NULL WHEN g = 1 THEN r ELSE 'SCHEMA_VALIDATION_FAILED' END AS reason, r IS NOT NULL AS retried, CAST(CASE WHEN r IS NULL OR g = 0 THEN 1 ELSE 0 END AS BIGINT) AS changed FROM v"""


@query("d20_proposal_retries", SQL_PROPOSALS)
def d20_proposals(spark, sf):
    return proposals(spark, sf)


@query("d21_sample_metrics", f"""
WITH d AS ({SQL_DIAGNOSES}), p AS ({SQL_PROPOSALS}), b AS (SELECT d.sample, d.outcome AS d, p.outcome AS p, hallucinated, changed, p.outcome <> 'abstains' AS s, ([NULL, 'A', 'B', 'C', 'D', NULL])[d.sample % 6 + 1] AS l FROM d JOIN p ON d.sample = p.sample)
SELECT sample, d = 'valid' AND p = 'valid' AS first_valid, d <> 'abstains' OR p = 'valid after retry' AS post_valid, d <> 'valid' OR p <> 'valid' AS retried, s AS precise, hallucinated, CASE WHEN s THEN changed ELSE 0 END AS diff_lines,
  s AND coalesce(l IN ('A', 'B', 'C', 'D'), false) AS level_a, s AND coalesce(l IN ('B', 'C', 'D'), false) AS level_b, s AND coalesce(l IN ('C', 'D'), false) AS level_c, s AND coalesce(l = 'D', false) AS level_d FROM b""")
def d21(spark, sf):
    n = F.col("doc_id")
    level = F.when((n % 6 > 0) & (n % 6 < 5), F.get(F.array(*map(F.lit, "ABCD")), (n % 6 - 1).cast("int")))
    levels = docs(spark, sf).select(n.alias("sample"), level.alias("level"))
    return answers.sample_metrics(diagnoses(spark, sf), proposals(spark, sf), levels)


@query("s16_recorded_answers", """
SELECT doc_id AS sample, CAST(a AS INTEGER) AS attempt, CASE WHEN a = 1 AND doc_id % 7 = 5 THEN 'timeout' WHEN a = 2 AND doc_id // 7 % 4 = 3 THEN 'unavailable' ELSE 'ok' END AS status,
  NOT (a = 1 AND doc_id % 7 = 5 OR a = 2 AND doc_id // 7 % 4 = 3) AS answered FROM documents, unnest(range(1, 3)) AS t(a)""")
def s16(spark, sf):
    path = scratch(spark, "answers")
    recorded(spark, sf).withColumn("status", F.when(F.col("status") != "ok", F.col("status"))).write.json(path)
    return files.recorded_answers(spark, path).select("sample", "attempt", "status", F.col("text").isNotNull().alias("answered"))


@query("x04_recorded_client", "SELECT doc_id AS sample, CAST(a AS INTEGER) AS attempt, CASE WHEN a = 1 AND doc_id % 7 = 5 THEN 'timeout' WHEN a = 3 OR a = 2 AND doc_id // 7 % 4 = 3 THEN 'unavailable' ELSE 'ok' END AS status FROM documents, unnest(range(1, 4)) AS t(a)")
def x04(spark, sf):
    asked = docs(spark, sf).select(F.col("doc_id").alias("sample"), F.lit("diagnosis").alias("task"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("attempt"))
    return answers.Client(recorded(spark, sf)).ask(asked).select("sample", "attempt", "status")


@query("s17_recorded_runs", """
WITH e AS (SELECT *, event_id % 50 * 10 AS o, CASE WHEN event_type = 'error' THEN length('  File "main.py", line 3, in f' || chr(10) || '    x' || chr(10) || 'ValueError: bad ' || user_id || chr(10)) ELSE 0 END AS s FROM events)
SELECT event_id AS run_id, CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 3 ELSE 0 END AS INTEGER) AS exit_code, o + s > 300 AS output_truncated, CAST(least(o, 300) AS BIGINT) AS out_bytes, CAST(least(s, greatest(300 - o, 0)) AS BIGINT) AS err_bytes,
  CASE WHEN event_type = 'error' THEN 'ValueError' WHEN event_id % 11 = 0 THEN 'TimeoutExpired' WHEN event_type = 'click' THEN 'SystemExit' END AS type,
  CASE WHEN event_type = 'error' THEN 'bad ' || user_id WHEN event_id % 11 = 0 THEN 'Execution exceeded timeout limit (5.0s).' WHEN event_type = 'click' THEN 'Process exited with non-zero code 3.' END AS message FROM e""")
def s17(spark, sf):
    path, e, n = scratch(spark, "runs"), F.col("event_type"), F.col("event_id")
    err = F.when(e == "error", F.concat(F.lit('  File "main.py", line 3, in f\n    x\nValueError: bad '), F.col("user_id").cast("string"), F.lit("\n"))).otherwise("")
    out = F.repeat(F.lit("0123456789"), (n % 50).cast("int"))
    rows = events(spark, sf).select(n.alias("run_id"), F.lit("main.py").alias("path"), F.when(e == "error", 1).when(e == "click", 3).otherwise(0).alias("exit_code"), out.alias("stdout"), err.alias("stderr"),
                                    F.col("value").alias("duration_seconds"), ((n % 11 == 0) & (e != "error")).alias("timed_out"))
    rows.write.json(path)
    got = files.recorded_runs(spark, path, most_bytes=300)
    return got.select("run_id", "exit_code", "output_truncated", F.octet_length("stdout").cast("long").alias("out_bytes"), F.octet_length("stderr").cast("long").alias("err_bytes"), "error_signature.type", "error_signature.message")


# --- levels and joins -----------------------------------------------------------------------------

SQL_GONE = """
b AS (SELECT user_id AS file, event_type AS code, event_id % 5 + 1 AS start_line, CASE WHEN event_id % 14 = 0 THEN NULL ELSE event_id % 5 + 1 END AS line, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
c AS (SELECT user_id AS file, event_type AS code, event_id % 5 + 1 AS line, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
g AS (SELECT b.file, b.code, start_line FROM b LEFT JOIN c ON b.file = c.file AND b.code = c.code AND b.line = c.line WHERE b.n > coalesce(c.n, 0)),
p AS (SELECT DISTINCT user_id AS file, user_id % 3 <> 0 AS base_valid, user_id % 5 <> 0 AS valid FROM events),
t AS (SELECT file, x.code, x.start_line FROM p, (VALUES ('error', 2), ('click', NULL), ('SyntaxError', NULL), ('view', 4)) AS x(code, start_line)),
m AS (SELECT t.file, t.code, CAST(t.start_line AS BIGINT) AS start_line, CASE WHEN t.start_line IS NOT NULL THEN EXISTS (SELECT 1 FROM g WHERE g.file = t.file AND g.code = t.code AND g.start_line = t.start_line)
  ELSE t.code = 'SyntaxError' AND NOT base_valid AND valid OR EXISTS (SELECT 1 FROM g WHERE g.file = t.file AND g.code = t.code) OR NOT EXISTS (SELECT 1 FROM c WHERE c.file = t.file AND c.code = t.code) END AS ok FROM t JOIN p USING (file))"""


def repairs(spark, sf):
    """(parsed, baseline, candidate, targets): findings of each user's even events before a repair, of odd ones after it."""
    base, cand = findings(spark, sf)
    parsed = events(spark, sf).select(F.col("user_id").alias("file")).distinct().select("file", (F.col("file") % 3 != 0).alias("base_valid"), (F.col("file") % 5 != 0).alias("valid"))
    wanted = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).cast("long").alias("start_line")) for c, n in (("error", 2), ("click", None), ("SyntaxError", None), ("view", 4))])
    return parsed, base.withColumn("start_line", F.col("id") % 5 + 1), cand, parsed.select("file", F.explode(wanted).alias("t")).select("file", "t.*")


@query("j03_targeted_eliminated", f"WITH {SQL_GONE} SELECT * FROM m")
def j03(spark, sf):
    parsed, base, cand, targets = repairs(spark, sf)
    return matching.targeted_eliminated(targets, base, cand, parsed)


@query("d16_level_a", f"""WITH {SQL_GONE}, k AS (SELECT file, code, line, n FROM (SELECT file, code, line, sum(n) AS n FROM b WHERE line IS NOT NULL GROUP BY ALL)),
i AS (SELECT c.file, sum(greatest(c.n - coalesce(k.n, 0), 0)) AS introduced FROM c LEFT JOIN k ON c.file = k.file AND c.code = k.code AND c.line = k.line GROUP BY c.file), o AS (SELECT file, bool_and(ok) AS gone FROM m GROUP BY file)
SELECT p.file, valid AND coalesce(introduced, 0) = 0 AND gone AS passed, valid AS parses, CAST(coalesce(introduced, 0) AS BIGINT) AS introduced, gone AS targets_gone FROM p LEFT JOIN i ON p.file = i.file JOIN o ON p.file = o.file""")
def d16(spark, sf):
    parsed, base, cand, targets = repairs(spark, sf)
    return matching.level_a(parsed, base, cand, targets)


@query("d16_level_a_of_programs", f"SELECT doc_id AS file, doc_id % 3 <> 0 AS passed, doc_id % 3 <> 0 AS parses FROM {SQL_PROGRAMS}")
def d16_programs(spark, sf):
    """Repaired programs, a third of them broken; only the parser tells. No findings, and syntax errors of the baseline are the targets."""
    n = F.col("doc_id")
    own = programs(spark, sf).withColumn("after", F.replace(F.col("source_code"), F.col("faulty"), F.when(n % 3 == 0, "def (:").otherwise(F.col("fixed"))))
    parsed = own.select(n.alias("file"), code.syntax(F.col("source_code")).isNull().alias("base_valid"), code.syntax(F.col("after")).isNull().alias("valid"))
    none = spark.createDataFrame([], "file long, code string, start_line long, line long")
    targets = parsed.filter("not base_valid").select("file", F.lit("SyntaxError").alias("code"), F.lit(None).cast("long").alias("start_line"))
    return matching.level_a(parsed, none, none.drop("start_line"), targets).select("file", "passed", "parses")


CALLS = sorted(costs.BUILTINS) + sorted(costs.METHODS) + ["mystery"]


@query("j10_cost_lookup", f"""
WITH c AS (SELECT event_id, ([{', '.join(map(literal, CALLS))}])[event_id % {len(CALLS)} + 1] AS name, event_id % {len(CALLS)} >= {len(costs.BUILTINS)} AS method FROM events)
SELECT event_id, name, CASE WHEN name = 'mystery' THEN NULL WHEN name IN ('sorted', 'sort') THEN 'O(n log n)' WHEN name IN ('min', 'max', 'sum', 'any', 'all') THEN 'O(n)'
  WHEN method AND name IN ('reverse', 'insert', 'remove', 'index', 'count', 'extend', 'copy', 'update') THEN 'O(n)' ELSE 'O(1)' END AS time,
  CASE WHEN name = 'mystery' THEN NULL WHEN name IN ('sorted', 'sort', 'copy') THEN 'O(n)' ELSE 'O(1)' END AS aux_space,
  CASE WHEN name <> 'mystery' THEN name IN ('append', 'extend') END AS amortized, CASE WHEN name <> 'mystery' THEN method AND name IN ('update', 'get', 'add', 'discard') END AS expected FROM c""")
def j10(spark, sf):
    at = (F.col("event_id") % len(CALLS)).cast("int")
    calls = events(spark, sf).select("event_id", F.get(F.array(*map(F.lit, CALLS)), at).alias("name"), F.when(at >= len(costs.BUILTINS), "method").otherwise("builtin").alias("kind"))
    dim = spark.createDataFrame(costs.cost_rows(), costs.COST_SCHEMA)
    return matching.costs_of(calls, "kind", "name", dim).select("event_id", "name", "time", "aux_space", "amortized", "expected")


MUTUAL = [
    "def even(n):\n    return odd(n - 1)\n\n\ndef odd(n):\n    return even(n - 1)\n\n\ndef main(n):\n    return even(main(n))\n",
    "class A:\n    def ping(self, n):\n        return self.pong(n)\n\n    def pong(self, n):\n        return self.ping(n - 1) + helper(n)\n\n\ndef helper(n):\n    return ping(n)\n",
    "def a(x):\n    return b(x)\n\n\ndef b(x):\n    return c(x)\n\n\ndef c(x):\n    return a(x)\n", "def (:\n",
]


@query("j12_mutual_methods", """
SELECT doc_id, on_self, caller, callee FROM documents JOIN (VALUES (0, false, 'even', 'odd'), (0, false, 'odd', 'even'), (1, true, 'ping', 'pong'), (1, true, 'pong', 'ping')) AS e(k, on_self, caller, callee) ON doc_id % 4 = k""")
def j12_methods(spark, sf):
    edges = matching.call_edges(code.structure(of_forms(spark, sf, MUTUAL), "doc_id", "source"), "doc_id")
    return matching.mutual_calls(edges, ["doc_id", "on_self"])


@query("j14_expected_vs_observed", f"""
SELECT doc_id, CASE kind WHEN 8 THEN 'syntax_error' WHEN 9 THEN 'assertion_failure' ELSE 'runtime_exception' END AS expected_status, doc_id IN (SELECT doc_id FROM labels) AS observed,
  doc_id IN (SELECT doc_id FROM labels) AND doc_id % 3 <> 0 AND (kind <> 8 OR NOT (doc_id % 7 <> 0 AND doc_id % 2 = 0)) AS passed FROM {SQL_PROGRAMS}""")
def j14(spark, sf):
    """The manifest of the generated programs against recorded runs; those of documents without a label are missing."""
    from ..sources import generator

    n, kind = F.col("doc_id"), F.col("category")
    category = F.when(kind == "SyntaxError", "syntax_error").when(kind == "logic_bug", "logic_bug").otherwise("standard_exception")
    manifest = programs(spark, sf).select("doc_id", category.alias("category"), generator.expected_status(kind, category).alias("expected_status"))
    runs = table(spark, sf, "labels").select("doc_id").distinct().select("doc_id", (n % 3).alias("exit_code"), (n % 2 == 0).alias("success"), (n % 7 != 0).alias("syntax_valid"))
    no = F.lit(False)
    passed = rules.bug_passed(F.col("category"), F.col("expected_status"), F.col("exit_code"), F.col("success"), F.col("syntax_valid"), no, no)
    return matching.expected_vs_observed(manifest, runs, "doc_id", passed).select("doc_id", "expected_status", "observed", "passed")


@query("d17_fault_location", """
WITH u AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS frame, min(event_id) FILTER (event_type = 'click') AS lint FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 4 = 0 THEN user_id WHEN user_id % 4 = 1 AND frame IS NOT NULL THEN frame WHEN user_id % 3 = 0 THEN 7 ELSE lint END AS line,
  CASE WHEN user_id % 4 = 0 THEN 'runtime_signature' WHEN user_id % 4 = 1 AND frame IS NOT NULL THEN 'runtime_frame' WHEN user_id % 3 = 0 THEN 'syntax_error' WHEN lint IS NOT NULL THEN 'linter_diagnostic' END AS origin FROM u""")
def d17(spark, sf):
    u, kind = F.col("user_id"), F.col("event_type")
    frame = F.struct(F.col("event_id").alias("line"), (kind == "error").alias("is_target"))
    own = events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(frame)).alias("all"), F.array_sort(F.collect_list(F.when(kind == "click", F.struct(F.col("event_id").alias("line"))))).alias("lint"))
    shown = F.when(u % 4 == 1, F.col("all")).otherwise(F.filter("all", lambda _: F.lit(False)))
    found = context.fault(F.when(u % 4 == 0, u), shown, F.when(u % 3 == 0, F.lit(7)), F.col("lint"))
    return own.select("user_id", found.alias("f")).select("user_id", "f.line", "f.origin")


@query("d18_budget_partition", "SELECT doc_id, CAST(doc_id % 1201 AS BIGINT) AS prompt, CAST(600 AS BIGINT) AS output, CAST(2048 - 600 - doc_id % 1201 AS BIGINT) AS margin FROM documents")
def d18_partition(spark, sf):
    return docs(spark, sf).select("doc_id", context.partition(F.col("doc_id") % 1201).alias("p")).select("doc_id", "p.*")


# --- others ---------------------------------------------------------------------------------------


@query("a12_samples_of_trees", """
WITH RECURSIVE n AS (SELECT event_id // 64 AS sample, event_id % 64 AS id, CASE WHEN event_id % 64 = 0 THEN NULL ELSE event_id % 64 - 1 - (event_id % 64) // 2 END AS parent, user_id FROM events),
t AS (SELECT sample, id, id AS root, user_id FROM n WHERE parent IS NULL UNION ALL SELECT n.sample, n.id, t.root, n.user_id FROM n JOIN t ON n.parent = t.id AND n.sample = t.sample)
SELECT sample, root, CAST(sum(user_id) AS BIGINT) AS total, count(*) AS n FROM t GROUP BY ALL""")
def a12_samples(spark, sf):
    nodes = events(spark, sf).selectExpr("event_id div 64 as sample", "event_id % 64 as id", "if(event_id % 64 = 0, null, event_id % 64 - 1 - (event_id % 64) div 2) as parent", "user_id")
    return stats.tree_sums(nodes, "user_id", "sample")


@query("a12_deep_trees", "SELECT event_id // 700 AS sample, CAST(0 AS BIGINT) AS root, CAST(sum(user_id) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def a12_deep(spark, sf):
    """Chains of up to 700 processes."""
    nodes = events(spark, sf).selectExpr("event_id div 700 as sample", "event_id % 700 as id", "nullif(event_id % 700, 0) - 1 as parent", "user_id")
    return stats.tree_sums(nodes, "user_id", "sample")


@query("w07_innermost_frame", """
SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'error'), max(event_id)) AS line, CASE WHEN bool_or(event_type = 'error') THEN 'ours' ELSE 'theirs' END AS file FROM events GROUP BY user_id""")
def w07(spark, sf):
    own = frames(spark, sf).select("user_id", F.transform("frames", lambda f: F.struct(F.when(f["is_target"], "ours").otherwise("theirs").alias("file"), f["event_id"].alias("line"), f["is_target"].alias("is_target"))).alias("frames"))
    return own.select("user_id", stats.innermost_frame(F.col("frames"), F.lit("ours")).alias("t")).select("user_id", "t.line", "t.file")


@query("p14_synced_fields", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value END) AS a, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value END) AS b FROM events")
def p14(spark, sf):
    a, b = F.when(F.col("event_id") % 2 == 0, F.col("value")), F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return events(spark, sf).select("event_id", rules.synced(a, b, ("a", "b")).alias("s")).select("event_id", "s.*")


@query("f27_edited_text", f"""
WITH v AS (SELECT doc_id, {SQL_LINES} AS l, right(text, 1) = chr(10) AS had FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 9 THEN array_to_string(list_concat(list_slice(l, 1, 2), ['one', 'two'], list_slice(l, 4, 5), ['new'], list_slice(l, 6, 7), list_slice(l, 10, len(l)), CASE WHEN doc_id % 3 > 0 THEN ['last'] ELSE [] END), chr(10))
  || CASE WHEN had OR doc_id % 3 = 2 THEN chr(10) ELSE '' END END AS whole FROM v""")
def f27_edited(spark, sf):
    """Edited documents, a line added after the last of some, with a line end of its own or none."""
    from ..operators import edits as E

    n = F.size("l").cast("long")
    more = F.struct(F.lit("insert").alias("operation"), (n + 1).alias("start_line"), n.alias("end_line"), F.lit("").alias("expected_text"), F.when(F.col("doc_id") % 3 == 1, "last").otherwise("last\n").alias("replacement_text"))
    rows = edited(spark, sf).withColumn("edits", F.when(F.col("doc_id") % 3 > 0, F.concat("edits", F.array(more).cast(f"array<{E.EDIT}>"))).otherwise(F.col("edits")))
    lines = E.apply_edits(F.col("text"), F.col("edits"))
    ends = E.keeps_final_newline(F.col("edits"), n, T.has_trailing_newline("text"))
    return rows.select("doc_id", F.when(lines.isNotNull(), T.reassemble(lines, F.lit("\n"), ends, F.lit(False))).alias("whole"))


@query("f42_tensor_names", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'token_embd.weight' WHEN 1 THEN 'blk.' || doc_id || '.attn_q.bias' WHEN 2 THEN 'blk.' || doc_id || '.ffn_norm.weight' WHEN 3 THEN 'model.layers.' || doc_id || '.other.weight' WHEN 4 THEN source ELSE 'output.weight' END AS name FROM documents""")
def f42(spark, sf):
    block = lambda part: F.concat(F.lit("model.layers."), F.col("doc_id").cast("string"), F.lit(f".{part}"))
    forms = F.array(F.lit("model.embed_tokens.weight"), block("self_attn.q_proj.bias"), block("post_attention_layernorm.weight"), block("other.weight"), F.col("source"), F.lit("lm_head.weight"))
    return docs(spark, sf).select("doc_id", T.tensor_name(F.get(forms, (F.col("doc_id") % 6).cast("int"))).alias("name"))


@query("t01_pipe_reads", "SELECT event_id, CAST(r AS BIGINT) AS read, CAST(least(4096, user_id * 97 - r * 4096) AS BIGINT) AS n_bytes FROM events, unnest(range(0, CAST(ceil(user_id * 97 / 4096.0) AS BIGINT))) AS t(r)")
def t01(spark, sf):
    return windows.drained(events(spark, sf).select("event_id", (F.col("user_id") * 97).alias("size")), "size").select("event_id", "read", "n_bytes")


@query("t02_stopped_runs", """
WITH c AS (SELECT user_id, event_id, value, CAST(floor(value) AS BIGINT) AS size, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS upto, value >= 90 + user_id % 60 AS late FROM events),
s AS (SELECT user_id, min(event_id) FILTER (upto >= 800) AS f, min(event_id) FILTER (late) AS l, max(upto) AS whole FROM c GROUP BY user_id),
k AS (SELECT c.user_id, max(upto) AS before FROM c JOIN s ON c.user_id = s.user_id AND c.event_id < s.l GROUP BY c.user_id)
SELECT s.user_id, CAST(CASE WHEN f IS NOT NULL AND (l IS NULL OR f <= l) THEN 800 WHEN l IS NOT NULL THEN least(coalesce(before, 0), 800) ELSE whole END AS BIGINT) AS stored,
  f IS NOT NULL AND (l IS NULL OR f <= l) AS truncated, l IS NOT NULL AND NOT (f IS NOT NULL AND f <= l) AS timed_out FROM s LEFT JOIN k ON s.user_id = k.user_id""")
def t02(spark, sf):
    """Runs that are stopped by a cap of output, or by their time."""
    chunks = events(spark, sf).select("user_id", "event_id", "value", F.floor("value").alias("size"))
    return windows.stopped_runs(chunks, "user_id", "event_id", "value", "size", 800, 90 + F.col("user_id") % 60)


@query("x02_analysers", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'python' END AS analyser FROM documents")
def x02(spark, sf):
    ends = F.get(F.array(*map(F.lit, (".py", ".PYW", ".c"))), (F.col("doc_id") % 3).cast("int"))
    return docs(spark, sf).select("doc_id", registry.default().column(F.concat("source", ends)).alias("analyser"))


@query("x03_token_counter", f"""
WITH v AS (SELECT doc_id, {SQL_LINES} AS l FROM documents), w AS (SELECT *, len(l) AS n, doc_id % greatest(len(l), 1) + 1 AS line, 0 AS k FROM v),
t AS (SELECT doc_id, {sql_prompt('1', 'n', True, 1)} AS a, {sql_prompt(SQL_FIRST, SQL_LAST, True, 1)} AS b FROM w)
SELECT doc_id, CASE WHEN a <= 700 THEN a WHEN b <= 700 THEN b END AS tokens FROM t""")
def x03(spark, sf):
    """Edit prompts under a counter of the caller's: a token for each character and a half, rounded up."""
    total = F.greatest(F.size("lines").cast("long"), F.lit(1))
    own = docs(spark, sf).select("doc_id", "text", T.lines("text").alias("lines")).withColumn("line", F.pmod("doc_id", total) + 1)
    none = F.expr("cast(array() as array<struct<code:string,line:bigint>>)")
    return own.select("doc_id", context.edit(F.col("text"), F.col("lines"), F.col("line"), none, F.lit(700), lambda x: F.ceil(F.length(x) / F.lit(1.5)).cast("long")).alias("c")).select("doc_id", "c.tokens")


@query("x05_measured_invocations", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT user_id, count(value) AS n, median(value) AS median, min(value) AS least, max(value) AS most, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS deviation FROM r WHERE k > 2 GROUP BY user_id""")
def x05(spark, sf):
    """Latencies of recorded invocations after two of warm-up; nothing is invoked."""
    return stats.timing(windows.measured(events(spark, sf).select("user_id", "event_id", "value"), ["user_id"], "event_id", 2), ["user_id"], "value")


@query("x06_resolved_functions", f"""
SELECT doc_id AS id, CASE WHEN kind <> 8 AND doc_id % 3 = 0 THEN name || '_' || doc_id END AS matched, CASE WHEN kind <> 8 AND doc_id % 3 = 0 THEN NULL ELSE 'not found' END AS problem FROM {SQL_PROGRAMS}""")
def x06(spark, sf):
    """Selectors of functions against what the files define: by name, by a name that is not there, by a class that is not. No module is imported."""
    own, n = programs(spark, sf), F.col("doc_id")
    stem = F.regexp_replace("target_file", r"\.py$", "")
    wanted = own.select(n.alias("id"), F.col("target_file").alias("file"), F.when(n % 3 == 2, "C").alias("class_name"), F.when(n % 3 == 1, F.concat(stem, F.lit("x"))).otherwise(stem).alias("function"))
    defined = code.definitions(own, "target_file", "source_code").filter("kind = 'function'").select(F.col("target_file").alias("file"), "ordinal", "name", "qualified_name", "is_method")
    return matching.resolve_selectors(wanted, defined)
