"""Joins, predicates, edits and validation over whole tables, by role mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import edits as E
from ..operators import matching as M
from ..operators import pairing
from ..operators import rules as R
from ..operators import scan
from .registry import query, table
from .scalars import SQL_LINES


def events(spark, sf):
    return table(spark, sf, "events")


def docs(spark, sf):
    return table(spark, sf, "documents")


# --- joins ----------------------------------------------------------------------------------------


@query("j01_grounding_anti", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j01(spark, sf):
    return M.ungrounded(docs(spark, sf).select("doc_id", "source"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("j01_ungrounded_ids", "SELECT doc_id, list_filter([doc_id % 4, doc_id % 3, doc_id % 4], lambda x: x NOT IN (0, 2)) AS ids FROM documents")
def j01_ids(spark, sf):
    n = F.col("doc_id")
    return docs(spark, sf).select("doc_id", M.ungrounded_ids(F.array(n % 4, n % 3, n % 4), F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("ids"))


BASE = "event_id % 2 = 0"
SQL_DIFF = """
WITH b AS (SELECT user_id AS file, event_type AS code, CASE WHEN event_id % 14 = 0 THEN NULL ELSE event_id % 5 + 1 END AS line, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
c AS (SELECT user_id AS file, event_type AS code, event_id % 5 + 1 AS line, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(b.file, c.file) AS file, coalesce(b.code, c.code) AS code, coalesce(b.line, c.line) AS line,
  coalesce(least(b.n, c.n), 0) * CAST(b.n IS NOT NULL AND c.n IS NOT NULL AS BIGINT) AS pre_existing,
  coalesce(b.n, 0) - CASE WHEN c.n IS NULL OR b.n IS NULL THEN 0 ELSE least(b.n, c.n) END AS eliminated, coalesce(c.n, 0) - CASE WHEN c.n IS NULL OR b.n IS NULL THEN 0 ELSE least(b.n, c.n) END AS introduced
FROM b FULL JOIN c ON b.file = c.file AND b.code = c.code AND b.line = c.line"""


def findings(spark, sf):
    e = events(spark, sf).selectExpr("event_id as id", "user_id as file", "event_type as code", "event_id % 5 + 1 as line", "event_id % 3 as col", "cast(event_id % 4 as string) as message")
    base = e.filter("id % 2 = 0").withColumn("line", F.when(F.col("id") % 14 != 0, F.col("line")))
    return base, e.filter("id % 2 = 1")


@query("j02_diff_counts", SQL_DIFF)
def j02(spark, sf):
    return M.diff_counts(*findings(spark, sf), ["file", "code", "line"])


@query("j02_diff_pairs")
def j02_pairs(spark, sf):
    return pairing.diff_pairs(*findings(spark, sf))


POINTS = "SELECT event_id, user_id AS file, event_id % 97 AS line_no FROM events"
SPANS = "SELECT event_id AS ordinal, user_id AS file, event_id % 83 AS start, event_id % 83 + event_id % 19 AS \"end\" FROM events"


def points(spark, sf):
    return events(spark, sf).selectExpr("event_id", "user_id as file", "event_id % 97 as line_no")


def spans(spark, sf):
    return events(spark, sf).selectExpr("event_id as ordinal", "user_id as file", "event_id % 83 as start", "event_id % 83 + event_id % 19 as end")


@query("j04_enclosing_function", f"""
SELECT event_id, p.file, line_no, arg_min(ordinal, ["end" - start, ordinal]) AS function FROM ({POINTS}) p LEFT JOIN ({SPANS}) s ON p.file = s.file AND line_no BETWEEN start AND "end" GROUP BY ALL""")
def j04(spark, sf):
    found = M.innermost(points(spark, sf), spans(spark, sf), "file", "line_no", "start", "end", "event_id", "ordinal")
    return found.select("event_id", "file", "line_no", F.col("span.ordinal").alias("function"))


@query("j05_overlapping_spans", f"""
SELECT a.ordinal AS a, b.ordinal AS b FROM ({SPANS}) a JOIN ({SPANS}) b ON a.file = b.file AND a.start <= b."end" AND a."end" >= b.start WHERE a.ordinal < b.ordinal""")
def j05(spark, sf):
    """Each pair of spans once, the smaller ordinal first."""
    s = spans(spark, sf)
    return M.overlapping(s, s, "file").filter("ordinal < ordinal_").select(F.col("ordinal").alias("a"), F.col("ordinal_").alias("b"))


@query("j06_band_split", """
WITH x AS (SELECT user_id, min(event_id % 83) AS lo, max(event_id % 41) AS hi FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT event_id, event_id % 97 BETWEEN lo AND hi AS inside FROM events JOIN x USING (user_id) WHERE event_type = 'error'""")
def j06(spark, sf):
    e = events(spark, sf)
    band = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min(F.expr("event_id % 83")).alias("lo"), F.max(F.expr("event_id % 41")).alias("hi"))
    return e.filter("event_type = 'error'").join(band, "user_id").select("event_id", F.expr("event_id % 97 between lo and hi").alias("inside"))


#: Edits of a document: replace line 3 by two lines, insert one line before line 6, delete lines 8 and 9.
EDITS = """array(named_struct('operation', 'replace', 'start_line', 3L, 'end_line', 3L, 'expected_text', coalesce(get(l, 2), ''), 'replacement_text', 'one\ntwo\n'),
  named_struct('operation', 'insert', 'start_line', 6L, 'end_line', 5L, 'expected_text', '', 'replacement_text', 'new'),
  named_struct('operation', 'delete', 'start_line', 8L, 'end_line', 9L, 'expected_text', concat_ws('\n', get(l, 7), get(l, 8)), 'replacement_text', ''))"""


def edited(spark, sf):
    return docs(spark, sf).withColumn("l", T.lines("text")).withColumn("edits", F.expr(EDITS).cast(f"array<{E.EDIT}>"))


def edited_files(spark, sf):
    """Of each text: its number of lines and its measured edits."""
    return edited(spark, sf).select("doc_id", F.size("l").cast("long").alias("n_lines"), E.measured(F.col("edits")).alias("edits"))


SQL_NUMBERS = f"(SELECT doc_id, n FROM (SELECT doc_id, {SQL_LINES} AS l FROM documents) AS s, unnest(range(1, len(l) + 1)) AS t(n))"


@query("j07_line_shift", f"SELECT doc_id, n, CASE WHEN n IN (3, 8, 9) THEN NULL ELSE n + CASE WHEN n > 3 THEN 1 ELSE 0 END + CASE WHEN n >= 6 THEN 1 ELSE 0 END - CASE WHEN n > 9 THEN 2 ELSE 0 END END AS mapped FROM {SQL_NUMBERS}")
def j07(spark, sf):
    return scan.mapped_files(edited_files(spark, sf), "doc_id", "n")


@query("j08_new_lines", f"SELECT doc_id, n, n IN (3, 4, 7) AS is_new FROM {SQL_NUMBERS}")
def j08(spark, sf):
    return scan.new_in_files(edited_files(spark, sf), "doc_id", "n")


@query("j09_first_mismatch", f"""
WITH v AS (SELECT doc_id, {SQL_LINES} AS l FROM documents) SELECT doc_id, CASE WHEN len(l) >= doc_id % 4 + 1 THEN doc_id % 4 END AS at FROM v""")
def j09(spark, sf):
    l = docs(spark, sf).withColumn("l", T.lines("text"))  # noqa: E741
    wrong = F.transform("l", lambda x, i: F.when(i == F.col("doc_id") % 4, F.concat(x, F.lit("!"))).otherwise(x))
    return l.select("doc_id", M.first_mismatch(wrong, F.col("l")).alias("at"))


@query("j11_unknown_calls", "SELECT user_id, arg_min(event_type, event_id) AS first_unknown FROM events WHERE event_type NOT IN ('view', 'click') AND event_type <> CAST(user_id AS VARCHAR) GROUP BY user_id")
def j11(spark, sf):
    known = spark.createDataFrame([("view",), ("click",)], "event_type string")
    found = M.unknown_calls(events(spark, sf).select(F.col("user_id").cast("string").alias("fn"), "event_id", "event_type"), known, "fn", "event_id", "event_type")
    return found.select(F.col("fn").cast("long").alias("user_id"), "first_unknown")


@query("j12_mutual_calls", """
WITH e AS (SELECT DISTINCT user_id AS caller, event_id % 150 AS callee FROM events WHERE user_id <> event_id % 150)
SELECT a.caller, a.callee FROM e a JOIN e b ON a.caller = b.callee AND a.callee = b.caller""")
def j12(spark, sf):
    return M.mutual_calls(events(spark, sf).selectExpr("user_id as caller", "event_id % 150 as callee"))


def functions_of(spark, sf):
    return docs(spark, sf).selectExpr("source as file", "doc_id as ordinal", "concat('f', doc_id % 7) as name", "if(doc_id % 2 = 0, concat('C', doc_id % 3, '.f', doc_id % 7), concat('f', doc_id % 7)) as qualified_name", "doc_id % 2 = 0 as is_method")


SQL_FUNCTIONS = "SELECT source AS file, doc_id AS ordinal, 'f' || doc_id % 7 AS name, CASE WHEN doc_id % 2 = 0 THEN 'C' || doc_id % 3 || '.f' || doc_id % 7 ELSE 'f' || doc_id % 7 END AS qualified_name, doc_id % 2 = 0 AS is_method FROM documents"


@query("j13_selectors", f"""
WITH f AS ({SQL_FUNCTIONS}), s AS (SELECT event_id AS id, 'src' || event_id % 25 AS file, CASE WHEN event_id % 3 = 0 THEN 'C' || event_id % 4 END AS cls, 'f' || event_id % 9 AS fn FROM events),
m AS (SELECT id, arg_min(qualified_name, ordinal) FILTER (cls IS NOT NULL AND qualified_name = cls || '.' || fn) AS ex, arg_min(qualified_name, ordinal) FILTER (cls IS NULL AND NOT is_method) AS top,
  arg_min(qualified_name, ordinal) FILTER (cls IS NULL AND is_method) AS meth, count(*) FILTER (cls IS NULL AND is_method) AS n FROM s LEFT JOIN f ON s.file = f.file AND s.fn = f.name GROUP BY id)
SELECT id, CASE WHEN id % 7 <> 3 THEN coalesce(ex, top, CASE WHEN n = 1 THEN meth END) END AS matched, CASE WHEN id % 7 = 3 THEN 'not found' WHEN coalesce(ex, top, CASE WHEN n = 1 THEN meth END) IS NOT NULL THEN NULL WHEN n > 1 THEN 'ambiguous' ELSE 'not found' END AS problem FROM m""")
def j13(spark, sf):
    s = events(spark, sf).selectExpr("event_id as id", "concat('src', event_id % 25) as file", "if(event_id % 3 = 0, concat('C', event_id % 4), null) as class_name", "concat('f', event_id % 9) as function")
    forms = F.array(F.lit(None).cast("string"), F.concat(F.lit("lib/"), F.upper("file")), F.concat(F.lit("C:\\x\\"), "file"), F.concat("file", F.lit("_other")))
    named = s.withColumn("named", F.get(forms, F.when(F.col("id") % 7 == 3, 3).otherwise(F.col("id") % 3).cast("int")))
    return M.resolve_selectors(named, functions_of(spark, sf), "named")


@query("j15_pivot_models", "SELECT event_type, avg(value) FILTER (user_id % 4 = 0) AS base, avg(value) FILTER (user_id % 4 = 1) AS tuned FROM events GROUP BY event_type")
def j15(spark, sf):
    rows = events(spark, sf).withColumn("model", F.when(F.col("user_id") % 4 == 0, "base").when(F.col("user_id") % 4 == 1, "tuned"))
    return rows.groupBy("event_type").pivot("model", ["base", "tuned"]).agg(F.avg("value"))


@query("j16_contained", """
SELECT event_id FROM events a WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND a.user_id = b.user_id AND a.event_id > b.event_id AND a.event_id <= b.event_id + b.event_id % 300)""")
def j16(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "event_type", F.col("event_id").alias("pre"), F.expr("event_id + event_id % 300").alias("post"))
    return scan.contained(e.filter("event_type = 'error'"), e.filter("event_type = 'view'"), "user_id").select("event_id")


@query("j17_nested_prefixes", f"""
WITH f AS ({SQL_FUNCTIONS}), s AS (SELECT event_id AS id, 'src' || event_id % 25 AS file, 'f' || event_id % 9 || '.inner' AS cls FROM events)
SELECT DISTINCT id FROM s JOIN f ON s.file = f.file AND (f.qualified_name = s.cls OR f.qualified_name = split_part(s.cls, '.', 1))""")
def j17(spark, sf):
    s = events(spark, sf).selectExpr("event_id as id", "concat('src', event_id % 25) as file", "concat('f', event_id % 9, '.inner') as class_name")
    return M.nested_prefixes(s, functions_of(spark, sf))


# --- predicates and projections -------------------------------------------------------------------


SQL_CATEGORY = "SELECT doc_id FROM documents WHERE {own} UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE {own})"


@query("p01_category_or_first", SQL_CATEGORY.format(own="lang = 'xx'"))
def p01(spark, sf):
    """A category that no row has: the first ten rows."""
    return R.category_or_first(docs(spark, sf), F.col("lang") == "xx", "doc_id", 10).select("doc_id")


@query("p01_category_present", SQL_CATEGORY.format(own="lang = 'de'"))
def p01_present(spark, sf):
    return R.category_or_first(docs(spark, sf), F.col("lang") == "de", "doc_id", 10).select("doc_id")


def frames(spark, sf):
    made = F.collect_list(F.struct("event_id", (F.col("event_type") == "error").alias("is_target")))
    return events(spark, sf).groupBy("user_id").agg(F.array_sort(made).alias("frames"))


@query("p02_target_frames", "SELECT user_id, coalesce(list(event_id ORDER BY event_id) FILTER (event_type = 'error'), []) AS target, coalesce(list(event_id ORDER BY event_id) FILTER (event_type <> 'error'), []) AS external FROM events GROUP BY user_id")
def p02(spark, sf):
    return frames(spark, sf).select("user_id", F.filter("frames", lambda f: f["is_target"])["event_id"].alias("target"), F.filter("frames", lambda f: ~f["is_target"])["event_id"].alias("external"))


@query("p03_only_external", "SELECT user_id, user_id % 3 <> 0 AND NOT bool_or(event_type = 'error') AS abstains FROM events GROUP BY user_id")
def p03(spark, sf):
    return frames(spark, sf).select("user_id", R.only_external(F.col("user_id") % 3, F.col("frames")).alias("abstains"))


@query("p04_defects", "SELECT event_id, event_id % 5 = 0 OR event_id % 7 = 1 OR event_type = 'error' OR coalesce(NOT CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) AS defect FROM events")
def p04(spark, sf):
    e, n = events(spark, sf), F.col("event_id")
    ok = F.when(n % 3 == 0, True).when(n % 3 == 1, False)
    return e.select("event_id", R.is_defect(n % 5 != 0, (n % 7 == 1).cast("int"), (F.col("event_type") == "error").cast("int"), ok).alias("defect"))


@query("p05_oracle_met", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 5 = 0 WHEN 1 THEN event_type = 'view' WHEN 2 THEN contains(event_type, 'i') AND event_id % 5 = 0 END AS met FROM events""")
def p05(spark, sf):
    n = F.col("event_id")
    out = F.concat(F.lit("\r\n"), "event_type", F.lit(" \r\n"))
    code = F.when(n % 4 == 1, 3).otherwise((n % 5 != 0).cast("int"))
    met = R.oracle_met(code, F.lit(False), out, F.when(n % 4 == 1, 3).when(n % 4 == 0, 0), F.when(n % 4 == 1, "view"), F.when(n % 4 == 2, "i"))
    return events(spark, sf).select("event_id", met.alias("met"))


@query("p06_any_error", "SELECT user_id, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id")
def p06(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.collect_set("event_type").alias("s")).select("user_id", F.exists("s", lambda x: x == "error").alias("any_error"))


@query("p07_envelopes", "SELECT event_id, event_type = 'view' AND event_id % 3 <> 0 AS ok FROM events")
def p07(spark, sf):
    envelope = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.col("event_type").alias("command"), F.lit(True).alias("success"), F.lit("a.py").alias("target_path"),
                                  F.struct("value").alias("data"), F.array(F.lit("")).alias("errors"), F.array(F.lit("")).alias("limitations")))
    put = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(envelope)
    return events(spark, sf).select("event_id", R.is_envelope(put, F.lit("view")).alias("ok"))


@query("p08_suite_verdicts", """
WITH e AS (SELECT event_id, event_id % 3 AS x, event_id % 2 = 0 AS s, event_id % 5 = 0 AS t, ['syntax_error', 'clean_success', 'timeout', 'output_overflow', 'runtime_exception', 'import_error', 'other'][event_id % 7 + 1] AS w FROM events)
SELECT event_id, CASE w WHEN 'syntax_error' THEN NOT (t AND s) AND x <> 0 WHEN 'clean_success' THEN x = 0 AND s WHEN 'timeout' THEN x = 4 OR t WHEN 'output_overflow' THEN t OR x <> 0 WHEN 'other' THEN true ELSE x <> 0 END AS bug,
  CASE WHEN s THEN t OR x <> 0 ELSE x = 0 END AS complexity, CASE WHEN s THEN x = 0 AND t AND event_id % 10 > 0 ELSE x <> 0 AND NOT t END AS profile, CASE WHEN s THEN x = 0 AND t ELSE x = 0 END AS boundary FROM e""")
def p08(spark, sf):
    n = F.col("event_id")
    x, s, t = n % 3, n % 2 == 0, n % 5 == 0
    w = F.get(F.array(*map(F.lit, ["syntax_error", "clean_success", "timeout", "output_overflow", "runtime_exception", "import_error", "other"])), (n % 7).cast("int"))
    return events(spark, sf).select(
        "event_id", R.bug_passed(F.when(w == "syntax_error", w).otherwise("run"), w, x, s, t, t, t).alias("bug"),
        R.complexity_passed(s, F.lit("O(n^2)"), F.lit("O(n²)"), F.when(t, "DYNAMIC_BOUNDS"), x).alias("complexity"),
        R.profile_passed(s, x, t, F.lit(True), n % 10).alias("profile"),
        R.boundary_passed(F.when(s, "encodings").otherwise("detection"), x, t, F.lit("CERTAIN"), F.lit(True)).alias("boundary"),
    )


@query("p09_pair_gates", """
WITH r AS (SELECT conv_id, list(role ORDER BY turn, role) AS r, max(length(text)) AS p, conv_id * 37 % 900 AS c FROM conversations GROUP BY conv_id)
SELECT conv_id, list_filter([CASE WHEN p > 1200 THEN 'prompt too long' END, CASE WHEN c > 600 THEN 'completion too long' END, CASE WHEN p + c + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END > 2048 THEN 'context too long' END,
  CASE WHEN conv_id % 5 = 0 THEN 'token sum' END, CASE WHEN conv_id % 7 > 2 THEN 'prompt count' END, CASE WHEN conv_id % 8 > 2 THEN 'completion count' END, CASE WHEN len(r) <> 3 THEN 'not three messages' END,
  CASE WHEN len(r) = 3 AND r[1] <> 'system' THEN 'message 0 is not system' END, CASE WHEN len(r) = 3 AND r[2] <> 'user' THEN 'message 1 is not user' END, CASE WHEN len(r) = 3 AND r[3] <> 'assistant' THEN 'message 2 is not assistant' END], lambda x: x IS NOT NULL) AS errors FROM r""")
def p09(spark, sf):
    """Every gate, each broken by some conversations."""
    n, p, c = F.col("conv_id"), F.col("p"), F.col("conv_id") * 37 % 900
    r = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role")))["role"].alias("r"), F.max(F.length("text")).alias("p"))
    total = p + c + F.when(n % 5 == 0, 1).otherwise(0)
    return r.select("conv_id", R.pair_errors(p, c, total, p + n % 7, c - n % 8, F.col("r")).alias("errors"))


@query("p10_record_checks", """
SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN l_linenumber > l_suppkey % 9 THEN 'reversed range' END, CASE WHEN l_partkey % 2 = 1 THEN 'deletion has new text' END], lambda x: x IS NOT NULL) AS errors FROM lineitem""")
def p10(spark, sf):
    e = F.struct(F.lit("delete").alias("operation"), F.col("l_linenumber").alias("start_line"), F.expr("l_suppkey % 9").alias("end_line"), F.lit("").alias("expected_text"), F.when(F.col("l_partkey") % 2 == 1, "x").otherwise("").alias("replacement_text"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", E.edit_errors(e).alias("errors"))


@query("p11_unsafe_paths", r"SELECT page_id, contains(url, '..') OR (contains(url, '/') AND page_id % 4 = 0) OR regexp_matches(url, '[&|;><`$]') AS unsafe FROM pages")
def p11(spark, sf):
    put = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("\\x"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", E.unsafe_path(put).alias("unsafe"))


@query("p12_target_names", "SELECT doc_id, doc_id % 5 NOT IN (2, 4) AS ok FROM documents")
def p12(spark, sf):
    forms = F.array(*[F.concat(F.lit(a), "source", F.lit(b)) for a, b in (("src/", ".py"), ("", ".py"), ("other/", ".py"), ("a/src/", ".py/"), ("../src/", ".py"))])
    return docs(spark, sf).select("doc_id", E.names_target(F.get(forms, (F.col("doc_id") % 5).cast("int")), F.concat(F.lit("src/"), "source", F.lit(".py"))).alias("ok"))


@query("p13_allowed_env", "SELECT doc_id, list_filter(['Path', CASE WHEN doc_id % 2 = 0 THEN 'TEMP' END], lambda x: x IS NOT NULL) AS names FROM documents")
def p13(spark, sf):
    env = F.create_map(F.lit("Path"), F.lit("x"), F.lit("PYTHONPATH"), F.lit("y"), F.when(F.col("doc_id") % 2 == 0, "TEMP").otherwise("HOME"), F.lit("z"))
    return docs(spark, sf).select("doc_id", F.array_sort(F.map_keys(R.allowed_env(env))).alias("names"))


@query("p15_profile_report", "SELECT user_id, min(event_id) / 1e6 AS import_ms, avg(event_id) / 1e6 AS mean_ms, max(user_id + event_id) AS heap_bytes FROM events GROUP BY user_id")
def p15(spark, sf):
    g = events(spark, sf).groupBy("user_id").agg(F.min("event_id").alias("i"), F.avg("event_id").alias("m"), F.max(F.col("user_id") + F.col("event_id")).alias("h"))
    return g.select("user_id", R.report(F.col("i"), F.col("m"), F.col("h")).alias("r")).select("user_id", "r.*")


@query("p16_exit_codes", "SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN 4 WHEN 'signup' THEN 6 ELSE 2 END::BIGINT AS code FROM events")
def p16(spark, sf):
    e = F.col("event_type")
    name = F.when(e == "error", "target_failure").when(e == "view", "success").when(e == "click", "timeout").when(e == "signup", "abstention").otherwise("usage")
    return events(spark, sf).select("event_id", R.exit_code(name).alias("code"))


# --- edits and validation -------------------------------------------------------------------------


@query("f26_apply_edits", f"""
WITH v AS (SELECT doc_id, {SQL_LINES} AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 9 THEN list_concat(list_slice(l, 1, 2), ['one', 'two'], list_slice(l, 4, 5), ['new'], list_slice(l, 6, 7), list_slice(l, 10, len(l))) END AS lines FROM v""")
def f26(spark, sf):
    rows = edited(spark, sf)
    return rows.select("doc_id", E.apply_edits(F.col("text"), F.col("edits")).alias("lines"))


@query("f28_changed_lines", f"WITH v AS (SELECT doc_id, {SQL_LINES} AS l FROM documents) SELECT doc_id, CAST(3 + CASE WHEN len(l) >= 9 THEN 2 WHEN len(l) >= 8 THEN 1 ELSE 0 END AS BIGINT) AS changed FROM v")
def f28(spark, sf):
    return edited(spark, sf).select("doc_id", E.changed_lines(F.col("edits")).alias("changed"))


@query("d14_signatures", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'ValueError' WHEN value > 50 THEN 'TimeoutExpired' WHEN event_id % 3 <> 0 THEN 'SystemExit' END AS type,
  CASE WHEN event_type = 'error' THEN 'bad' WHEN value > 50 THEN 'Execution exceeded timeout limit (5.0s).' WHEN event_id % 3 <> 0 THEN 'Process exited with non-zero code ' || event_id % 3 || '.' END AS message FROM events""")
def d14(spark, sf):
    parsed = F.when(F.col("event_type") == "error", F.struct(F.lit("ValueError").alias("type"), F.lit("bad").alias("message"), F.lit("a.py").alias("file")))
    sig = R.signature(F.col("value") > 50, F.col("event_id") % 3, parsed, F.lit(5))
    return events(spark, sf).select("event_id", sig.alias("s")).select("event_id", "s.type", "s.message")


@query("d15_validation_levels", """
WITH p AS (SELECT event_id, event_type AS t, event_id % 3 AS x, value > 50 AS late, lag(event_type) OVER w AS bt, lag(event_id % 3) OVER w AS bx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
q AS (SELECT *, CASE WHEN late THEN false WHEN x = 0 THEN true WHEN bt = 'error' THEN t <> 'error' WHEN coalesce(bx, 0) <> 0 THEN x <> bx ELSE false END AS gone FROM p)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN x = 0 AND NOT late AND event_id % 2 = 0 THEN 'D' WHEN x = 0 AND NOT late THEN 'C' WHEN gone THEN 'B' ELSE 'A' END AS level FROM q""")
def d15(spark, sf):
    from pyspark.sql import Window

    n = F.col("event_id")
    sig = F.when(F.col("event_type") == "error", F.struct(F.lit("E").alias("type"), F.lit("m").alias("message"), F.lit("a.py").alias("file")))
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf).select("event_id", "user_id", "value", (n % 3).alias("x"), sig.alias("sig")).withColumns({"late": F.col("value") > 50})
    rows = rows.withColumns({"bx": F.lag("x").over(w), "bsig": F.lag("sig").over(w)})
    same = T.same_signature(F.col("bsig"), F.col("sig"))
    gone = R.failure_gone(F.col("bx"), F.col("bsig"), F.col("x"), F.col("late"), same)
    clean = (F.col("x") == 0) & ~F.col("late")
    return rows.select("event_id", R.level(n % 11 != 0, gone, clean, F.when(n % 2 == 0, True)).alias("level"))
