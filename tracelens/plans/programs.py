"""Sources, sinks, generated programs and what parsers find in them.

``documents`` gives the ordinals of generated programs (see ``sources.generator``): 31 programs of ten kinds, whose names, file names and line numbers change
with doc_id. What is true of each is written out by hand in ``FACTS``, and the SQL reads that.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import costs
from ..functions import text as T
from ..operators import code, registry, stats, tracebacks, windows
from ..session import own_folder
from ..sources import files, generator, rollups, sinks
from ..streaming import runs, suites
from .aggregates import suites as suite_rows
from .registry import query, table
from .scalars import SQL_LINES


def docs(spark, sf):
    return table(spark, sf, "documents")


def programs(spark, sf):
    return generator.sources(spark, docs(spark, sf).select(F.col("doc_id").alias("ordinal"))).withColumnRenamed("ordinal", "doc_id")


def scratch(spark, name: str) -> str:
    """A new folder that all executors share; it goes when the application ends."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Of each program: kind, variant, name, faulty line, last line, parameters, greatest loop depth, whether it calls itself, classes of time and of
#: auxiliary space, why no class is given, confidence. Lines count without the comments in front.
FACTS = [
    (0, 0, "ratio", 3, 3, "values", 0, False, "O(n)", "O(1)", None, "HIGH"), (0, 1, "share", 3, 3, "part whole", 0, False, "O(1)", "O(1)", None, "HIGH"),
    (0, 2, "slot", 2, 2, "index size", 0, False, "O(1)", "O(1)", None, "HIGH"), (0, 3, "spread", 3, 3, "value low high", 0, False, "O(1)", "O(1)", None, "HIGH"),
    (0, 4, "rates", 4, 5, "counts seconds", 1, False, "O(n)", "O(1)", None, "MEDIUM"),
    (1, 0, "walk", 3, 5, "items", 1, False, "O(n)", "O(1)", None, "MEDIUM"), (1, 1, "last", 2, 2, "items", 0, False, "O(1)", "O(1)", None, "HIGH"),
    (1, 2, "take", 2, 3, "stack", 0, False, "O(1)", "O(1)", None, "HIGH"), (1, 3, "steps", 3, 5, "rows", 1, False, "O(n)", "O(1)", None, "MEDIUM"),
    (2, 0, "pick", 2, 3, "lookup key", 0, False, "O(1)", "O(1)", None, "HIGH"), (2, 1, "tally", 4, 5, "words", 1, False, "O(n)", "O(1)", None, "MEDIUM"),
    (2, 2, "deep", 2, 2, "config", 0, False, "O(1)", "O(1)", None, "HIGH"),
    (3, 0, "label", 2, 2, "name count", 0, False, "O(1)", "O(1)", None, "HIGH"), (3, 1, "bill", 4, 5, "prices", 1, False, "O(n)", "O(1)", None, "MEDIUM"),
    (3, 2, "call", 2, 2, "value", 0, False, "UNKNOWN", "UNKNOWN", "UNKNOWN_CALL", "LOW"), (3, 3, "cell", 2, 3, "grid", 0, False, "O(1)", "O(1)", None, "HIGH"),
    (4, 0, "grow", 4, 5, "items", 1, False, "UNKNOWN", "UNKNOWN", "UNKNOWN_CALL", "LOW"), (4, 1, "trim", 2, 3, "name", 0, False, "UNKNOWN", "UNKNOWN", "UNKNOWN_CALL", "LOW"),
    (4, 2, "first", 2, 2, "rows", 0, False, "O(1)", "O(1)", None, "HIGH"),
    (5, 0, "parse", 2, 2, "text", 0, False, "O(1)", "O(1)", None, "HIGH"), (5, 1, "halves", 2, 3, "items", 0, False, "O(1)", "O(1)", None, "HIGH"),
    (5, 2, "find", 2, 2, "items wanted", 0, False, "O(n)", "O(1)", None, "HIGH"),
    (6, 0, "area", 2, 2, "width height", 0, False, "O(1)", "O(1)", None, "HIGH"), (6, 1, "merge", 4, 4, "parts", 1, False, "O(n)", "O(1)", None, "MEDIUM"),
    (7, 0, "down", 2, 2, "n", 0, True, "UNKNOWN", "UNKNOWN", "DYNAMIC_RECURSION", "LOW"),
    (8, 0, "open", 1, 2, "", 0, False, "UNKNOWN", "UNKNOWN", "UNSUPPORTED_SYNTAX", "LOW"), (8, 1, "gap", 1, 2, "", 0, False, "UNKNOWN", "UNKNOWN", "UNSUPPORTED_SYNTAX", "LOW"),
    (9, 0, "pairs", 5, 6, "left right", 2, False, "O(nm)", "O(1)", None, "MEDIUM"), (9, 1, "best", 4, 6, "items", 1, False, "O(n)", "O(1)", None, "MEDIUM"),
    (9, 2, "search", 6, 9, "items wanted", 1, False, "O(log n)", "O(1)", None, "MEDIUM"), (9, 3, "fact", 3, 4, "n", 0, True, "O(n)", "O(n)", None, "MEDIUM"),
]


def literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


KIND = "doc_id % 10"
#: Programs with their facts: a row for each document; ``pad`` comment lines stand first.
SQL_PROGRAMS = f"""(SELECT d.doc_id, d.doc_id % 4 AS pad, f.* FROM documents d JOIN (VALUES {', '.join('(' + ', '.join(map(literal, f)) + ')' for f in FACTS)})
  AS f(kind, variant, name, fault, last, params, depth, recursive, time, aux_space, reason, confidence)
  ON d.doc_id % 10 = f.kind AND (d.doc_id // 10) % ([{', '.join(map(str, generator.VARIANTS))}])[d.doc_id % 10 + 1] = f.variant)"""


# --- sources and sinks ----------------------------------------------------------------------------


@query("s01_target_facts", """
SELECT 'doc_' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS file_size_bytes, sha256(text) AS sha256, 'utf-8' AS encoding, false AS has_bom, chr(10) AS newline_style, right(text, 1) = chr(10) AS has_trailing_newline, false AS is_binary FROM documents WHERE strlen(text) <= 262144""")
def s01(spark, sf):
    raw = F.col("text").cast("binary")
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return docs(spark, sf).filter(F.octet_length("text") <= files.MOST_SOURCE).select(*files.target_columns(path, raw))


@query("s01_scanned_files", "SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes, true AS decodes, true AS ends FROM documents GROUP BY source")
def s01_files(spark, sf):
    """Files of each source's texts, written and scanned as files: their sizes, whether all decode as declared and end with a line end."""
    path = scratch(spark, "sources")
    docs(spark, sf).select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    found = files.scan(spark, path, most=1 << 30)
    source = F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source")
    return found.groupBy(source).agg(F.sum("file_size_bytes").alias("n_bytes"), F.bool_and(F.col("encoding") == "utf-8").alias("decodes"), F.bool_and("has_trailing_newline").alias("ends"))


@query("s02_decoded_text", "SELECT doc_id, text FROM documents")
def s02(spark, sf):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return files.texts(docs(spark, sf).select("doc_id", raw.alias("content"))).select("doc_id", "text")


@query("s03_decoded_with_fallback", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# coding: nonsense' || chr(10) || text || chr(65533) ELSE text END AS text FROM documents")
def s03(spark, sf):
    """Whole texts, half of them with an unknown coding and a byte that is no UTF-8."""
    own = F.col("text").cast("binary")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(b"# coding: nonsense\n"), own, F.lit(b"\xff"))).otherwise(own)
    return files.texts(docs(spark, sf).select("doc_id", raw.alias("content"))).select("doc_id", "text")


@query("s04_json_items", "SELECT doc_id AS id, source AS category, text FROM documents")
def s04(spark, sf):
    """JSON documents of about a megabyte of one source each, written over several lines, in files of their own."""
    path = scratch(spark, "manifest")
    item = F.struct(F.col("doc_id").alias("id"), F.col("source").alias("category"), "text")
    files.json_documents(docs(spark, sf), "source", "doc_id", item, F.lit("d").alias("dataset"), "samples").write.option("maxRecordsPerFile", 1).text(path)
    return files.json_items(spark, path, "struct<id:bigint,category:string,text:string>", "samples")


@query("s05_json_lines", "SELECT doc_id, lang, text FROM documents")
def s05(spark, sf):
    path = scratch(spark, "lines")
    docs(spark, sf).select("doc_id", "lang", "text").write.json(path)
    return files.json_lines(spark, path, "doc_id bigint, lang string, text string")


@query("s05_first_valid_lines", "SELECT least(25, count(*) FILTER (doc_id % 3 <> 0)) AS n, true AS whole FROM documents")
def s05_first(spark, sf):
    """The limit counts rows that parse: every third line is broken, and blank ones stand between."""
    path = scratch(spark, "broken")
    value = F.when(F.col("doc_id") % 3 == 0, '{"doc_id": ').when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit("}\n"))).otherwise(F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit("}")))
    docs(spark, sf).select(value.alias("value")).write.text(path)
    return files.json_lines(spark, path, "doc_id bigint", first=25).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("doc_id") % 3 != 0), F.lit(True)).alias("whole"))


@query("s06_split_union", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM documents")
def s06(spark, sf):
    path = scratch(spark, "splits")
    split = F.when(F.col("doc_id") % 10 == 0, "val").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    rows = docs(spark, sf).select("doc_id", split.alias("split")).persist()
    for name in ("train", "val", "test"):
        rows.filter(F.col("split") == name).select("doc_id").write.json(f"{path}/{name}.jsonl")
    rows.unpersist()
    return files.splits(spark, path, "doc_id bigint")


@query("s07_profile_inputs", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['not an object'] WHEN 2 THEN ['unknown field'] WHEN 3 THEN ['keyword name'] ELSE ['too deep'] END AS errors FROM events""")
def s07(spark, sf):
    deep = '{"args": ' + "[" * 21 + "]" * 21 + "}"
    forms = F.array(F.concat(F.lit('{"args": [1], "kwargs": '), "props", F.lit("}")), F.lit("[1]"), F.concat(F.lit('{"extra": '), "props", F.lit("}")), F.lit('{"kwargs": {"a b": 1}}'), F.lit(deep))
    return table(spark, sf, "events").select("event_id", files.input_errors(F.get(forms, (F.col("event_id") % 5).cast("int"))).alias("errors"))


@query("s08_lint_findings", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'E' || user_id WHEN 1 THEN 'RUFF' ELSE 'MalformedOutput' END AS code, CASE event_id % 3 WHEN 0 THEN 'error' ELSE 'warning' END AS severity,
  CAST(CASE event_id % 3 WHEN 0 THEN greatest(1, user_id) ELSE 1 END AS BIGINT) AS start_line, CAST(CASE event_id % 3 WHEN 0 THEN greatest(1, user_id) ELSE 1 END AS BIGINT) AS end_line, event_id % 3 = 0 AS fix_available FROM events""")
def s08(spark, sf):
    full = F.concat(F.lit('[{"code": "E'), F.col("user_id").cast("string"), F.lit('", "severity": "Error", "location": {"row": '), F.col("user_id").cast("string"), F.lit(', "column": 0}, "end_location": {"row": 0}, "fix": {"a": 1}}]'))
    raw = F.get(F.array(full, F.lit("[{}]"), F.lit("boom {")), (F.col("event_id") % 3).cast("int"))
    rows = table(spark, sf, "events").select("event_id", F.explode(files.findings(raw)).alias("f"))
    return rows.select("event_id", "f.code", "f.severity", "f.start_line", "f.end_line", "f.fix_available")


@query("s09_split_files", "SELECT lang AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY lang")
def s09(spark, sf):
    path = scratch(spark, "partitioned")
    sinks.write_splits(docs(spark, sf).select("doc_id", F.col("lang").alias("split")), path)
    return spark.read.schema("doc_id bigint, split string").json(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("s09_committed_splits", "SELECT 'all' AS name, count(*) AS n FROM documents UNION ALL SELECT lang, count(*) FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY lang")
def s09_committed(spark, sf):
    """What the manifest of the split files says, counted as they were written."""
    path = scratch(spark, "committed")
    langs = ["en", "de", "fr", "es"]
    sinks.write_splits(docs(spark, sf).select("doc_id", "text", F.col("lang").alias("split")), path, names=langs)
    made = sinks.read_manifest(spark, path)
    return spark.createDataFrame([("all", made["total_samples"]), *((k, made[k]) for k in langs if made[k])], "name string, n bigint")


@query("a01_kept_up_to_date", """
SELECT event_type, count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_id % 3 <> 0) AS schema_valid, min(value) AS min_ms, max(value) AS max_ms, avg(value) AS mean_ms, max(user_id) AS peak_bytes,
  true AS median_holds, true AS users_hold FROM events GROUP BY event_type""")
def a01_kept(spark, sf):
    """The suite summary from states of each day: three increments, one of them added twice, a compaction, and a fourth. The sketches' figures are held against exact ones."""
    rows = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    made = rollups.suite_measures(F.col("event_type") != "error", F.col("event_id") % 3 != 0, F.col("value"), F.col("user_id"), F.col("user_id"))
    store = rollups.Rollup(spark, scratch(spark, "rollup"), ["event_type", "day"], made)
    for i in (0, 1, 2, 1):
        store.add(f"part-{i}", rows.filter(F.col("event_id") % 4 == i))
    store.compact()
    store.add("part-3", rows.filter(F.col("event_id") % 4 == 3))
    found = rollups.suite_summary(store.merged(["event_type"]))
    exact = rows.groupBy(F.col("event_type").alias("__type")).agg(F.count_distinct("user_id").alias("__users"))
    ranks = rows.join(F.broadcast(found.select(F.col("event_type").alias("__of"), "median_ms")), F.col("event_type") == F.col("__of")).groupBy("__of").agg(F.avg((F.col("value") <= F.col("median_ms")).cast("double")).alias("__rank"))
    both = found.join(exact, F.col("event_type") == F.col("__type")).join(ranks, F.col("event_type") == F.col("__of"))
    holds = [(F.abs(F.col("__rank") - 0.5) < 0.05).alias("median_holds"), (F.abs(F.col("n_who") - F.col("__users")) <= 0.1 * F.col("__users")).alias("users_hold")]
    return both.select("event_type", "total", "passed", "schema_valid", "min_ms", "max_ms", "mean_ms", "peak_bytes", *holds)


@query("a08_kept_up_to_date", "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user', CAST(user_id % 7 AS VARCHAR), count(*) FROM events GROUP BY 2")
def a08_kept(spark, sf):
    """Frequency tables from states of each day, added in two increments."""
    pairs = F.array(F.struct(F.lit("event_type").alias("dimension"), F.col("event_type").alias("value")), F.struct(F.lit("user").alias("dimension"), (F.col("user_id") % 7).cast("string").alias("value")))
    rows = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.inline(pairs))
    store = rollups.Rollup(spark, scratch(spark, "frequencies"), ["dimension", "value", "day"], {"n": rollups.total()})
    for i in range(2):
        store.add(f"part-{i}", rows.filter(F.col("event_id") % 2 == i))
    return store.merged(["dimension", "value"])


@query("s10_manifest", "SELECT CAST(count(*) AS VARCHAR) AS total, CAST(count(*) FILTER (lang = 'en') AS VARCHAR) AS en, CAST(round(count(*) FILTER (lang = 'en') / count(*) * 100.0::DOUBLE, 2) AS DOUBLE) AS en_pct, CAST(max(n_chars) AS VARCHAR) AS longest FROM documents")
def s10(spark, sf):
    m = sinks.manifest(docs(spark, sf), "documents", "lang", "source", "lang", ["n_chars"])
    at = lambda p: F.get_json_object("json", p)
    return m.select(at("$.total_samples").alias("total"), at("$.category_distribution.en").alias("en"), at("$.splits.en.percentage").cast("double").alias("en_pct"), at("$.token_statistics.n_chars.max").alias("longest"))


@query("s11_envelopes", """
SELECT doc_id, '{"schema_version":"1.0","command":"info","success":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"target_path":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || source || '"' END
  || ',"data":{"n_chars":' || n_chars || '},"errors":[],"limitations":["' || lang || '"],"metadata":{}}' AS json FROM documents""")
def s11(spark, sf):
    json = sinks.envelope("info", F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.struct("n_chars"), F.array().cast("array<string>"), F.array("lang"))
    return docs(spark, sf).select("doc_id", json.alias("json"))


@query("s12_markdown_report", """
SELECT '| event_type | total | passed |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || event_type || ' | ' || total || ' | ' || passed || ' |', chr(10) ORDER BY event_type) AS markdown
FROM (SELECT event_type, count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed FROM events GROUP BY 1)""")
def s12(spark, sf):
    return sinks.markdown_table(suite_rows(spark, sf), ["event_type", "total", "passed"], "event_type")


CATEGORY = f"([{', '.join(map(literal, generator.KINDS))}])[{{}} % 10 + 1]"


@query("s13_generated_pairs", f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS i, (SELECT count(*) FROM documents) AS total FROM documents),
p AS (SELECT doc_id, i, CASE WHEN i < CAST(floor(total * 0.41::DOUBLE) AS BIGINT) THEN 0 WHEN i < 2 * CAST(floor(total * 0.41::DOUBLE) AS BIGINT) THEN 1 ELSE 2 END AS t, CAST(floor(total * 0.41::DOUBLE) AS BIGINT) AS part FROM r),
o AS (SELECT doc_id, t, i - t * part AS o FROM p)
SELECT doc_id, CASE t WHEN 0 THEN 'ft_diag' WHEN 1 THEN 'ft_edit' ELSE 'ft_abst' END || '_' || printf('%05d', o + 1) AS id, CASE t WHEN 0 THEN 'diagnosis' WHEN 1 THEN 'edit_proposal' ELSE 'abstention' END AS task_type,
  CASE WHEN t < 2 THEN {CATEGORY.format('o')} ELSE (['clean_code', 'external_dependency', 'out_of_bounds', 'prompt_budget_exceeded'])[o % 4 + 1] END AS category,
  CASE WHEN t = 2 THEN (['UNGROUNDED_EVIDENCE', 'UNGROUNDED_EVIDENCE', 'OUT_OF_BOUNDS_LINES', 'PROMPT_BUDGET_EXCEEDED'])[o % 4 + 1] END AS reason FROM o""")
def s13(spark, sf):
    """A pair for each document, by its place among all."""
    d = docs(spark, sf).select("doc_id")
    return generator.pairs_of(windows.positions(d, "doc_id"), "__pos", d.count()).select("doc_id", "id", "task_type", "category", "reason")


@query("s14_template_cases", f"SELECT doc_id, {CATEGORY.format('doc_id')} AS category, CAST(variant AS INTEGER) AS variant, name || '_' || doc_id || '.py' AS target_file, CAST(fault + pad AS BIGINT) AS fault_line FROM {SQL_PROGRAMS}")
def s14(spark, sf):
    return programs(spark, sf).select("doc_id", "category", "variant", "target_file", "fault_line")


@query("s14_abstention_cases", """
SELECT doc_id, (['clean_code', 'external_dependency', 'out_of_bounds', 'prompt_budget_exceeded'])[doc_id % 4 + 1] AS category, (['UNGROUNDED_EVIDENCE', 'UNGROUNDED_EVIDENCE', 'OUT_OF_BOUNDS_LINES', 'PROMPT_BUDGET_EXCEEDED'])[doc_id % 4 + 1] AS reason,
  (['total_', 'fetch_', 'tiny_', 'wide_'])[doc_id % 4 + 1] || doc_id || '.py' AS target_file, CAST(([5, 5, 2, 152])[doc_id % 4 + 1] + doc_id % 4 AS BIGINT) AS n_lines FROM documents""")
def s14_none(spark, sf):
    own = generator.abstentions(spark, docs(spark, sf).select(F.col("doc_id").alias("ordinal"))).withColumnRenamed("ordinal", "doc_id")
    return own.select("doc_id", "category", "reason", "target_file", T.line_count("source_code").alias("n_lines"))


@query("s15_manifest", f"""
SELECT 'bugs' AS dataset, CAST(count(*) AS VARCHAR) AS total, CAST(sum(fault + pad) AS BIGINT) AS faults, count(*) FILTER (kind = 8) AS syntax, CAST(sum(greatest(last, 1) + pad) AS BIGINT) AS row_count, min(name || '_' || doc_id || '.py') AS first FROM {SQL_PROGRAMS}""")
def s15_manifest(spark, sf):
    """A manifest of all generated programs, against a listing of their files with line counts, written and read back; its head's counts come from the write."""
    own = programs(spark, sf)
    category = F.when(F.col("category") == "SyntaxError", "syntax_error").when(F.col("category") == "logic_bug", "logic_bug").otherwise("standard_exception")
    entries = own.select(F.concat(F.lit("bug_"), F.col("doc_id").cast("string")).alias("id"), F.col("target_file").alias("path"), category.alias("category"), F.col("category").alias("error_type"), F.col("fault_line").cast("string").alias("description"))
    entries = entries.withColumn("expected_status", generator.expected_status(F.col("error_type"), F.col("category")))
    listing = own.select(F.col("target_file").alias("path"), T.line_count("source_code").alias("n_rows"))
    path = scratch(spark, "bugs")
    made = sinks.commit(generator.manifest_samples(listing, entries), path, "bugs", sinks.per_value("expected_status", ["syntax_error"]))
    rows = files.json_lines(spark, path, "path string, category string, description string, row_count bigint")
    found = rows.agg(F.sum(F.col("description").cast("long")).alias("faults"), F.sum("row_count").alias("row_count"), F.min("path").alias("first"))
    return found.select(F.lit(made["dataset_name"]).alias("dataset"), F.lit(str(made["total_samples"])).alias("total"), "faults", F.lit(made["syntax_error"]).alias("syntax"), "row_count", "first")


@query("s15_complexity_manifest", f"""
SELECT name || '_' || doc_id || '.py' AS path, name || '_' || doc_id AS selector, CASE time WHEN 'UNKNOWN' THEN NULL ELSE time END AS expected_time, reason IS NOT NULL AS should_abstain, CAST(last + pad AS BIGINT) AS row_count FROM {SQL_PROGRAMS} WHERE kind <> 8""")
def s15_complexity(spark, sf):
    """A manifest of what is inferred of all generated functions, read back from its JSON."""
    own = programs(spark, sf)
    found = code.complexities(own.select("target_file", "source_code"), "target_file", "source_code").filter("target <> '<module>'")
    entries = found.select(F.col("target_file").alias("path"), F.col("target").alias("selector"), F.when(F.col("reason").isNull(), F.col("time")).alias("expected_time"), F.col("reason").isNotNull().alias("should_abstain"))
    listing = own.select(F.col("target_file").alias("path"), T.line_count("source_code").alias("n_rows"))
    path = scratch(spark, "complexity")
    sinks.commit(generator.manifest_samples(listing, entries), path, "complexity")
    return files.json_lines(spark, path, "path string, selector string, expected_time string, should_abstain boolean, row_count bigint")


@query("s15_missing_files", "SELECT 'doc_' || doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s15(spark, sf):
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path")
    return generator.missing_files(docs(spark, sf).select(path), table(spark, sf, "labels").select(path))


# --- parsers --------------------------------------------------------------------------------------


@query("d01_syntax", f"SELECT doc_id, kind = 8 AS broken FROM {SQL_PROGRAMS}")
def d01(spark, sf):
    return programs(spark, sf).select("doc_id", code.syntax(F.col("source_code")).isNotNull().alias("broken"))


@query("d02_definitions", f"""
SELECT doc_id, name || '_' || doc_id AS name, CAST(1 + pad AS BIGINT) AS start, CAST(last + pad AS BIGINT) AS "end", string_split(params, ' ') AS parameters FROM {SQL_PROGRAMS} WHERE kind <> 8""")
def d02(spark, sf):
    return code.definitions(programs(spark, sf), "doc_id", "source_code").select("doc_id", "name", "start", "end", "parameters")


@query("d03_structure", f"SELECT doc_id, CAST(depth AS BIGINT) AS max_depth, recursive FROM {SQL_PROGRAMS} WHERE kind <> 8")
def d03(spark, sf):
    rows = code.structure(programs(spark, sf), "doc_id", "source_code")
    return code.loop_summary(rows, "doc_id").select("doc_id", "max_depth", "recursive")


@query("d04_input_needs", "SELECT doc_id, doc_id % 3 <> 2 AS requires, doc_id % 3 = 1 AS in_loop, CAST(CASE doc_id % 3 WHEN 2 THEN 0 ELSE 1 END AS BIGINT) AS count, CASE doc_id % 3 WHEN 0 THEN ['name?'] ELSE [] END AS prompts FROM documents")
def d04(spark, sf):
    forms = F.array(*map(F.lit, ["x = input('name?')\n", "import sys\nfor i in range(3):\n    y = sys.stdin.readline()\n", "z = 1\n"]))
    return docs(spark, sf).select("doc_id", code.input_needs(F.get(forms, (F.col("doc_id") % 3).cast("int"))).alias("n")).select("doc_id", "n.*")


O1, ON, ONM = "'O(1)'", "'O(n)'", "'O(nm)'"
UNK = "'UNKNOWN'"


@query("d05_complexity", f"SELECT doc_id, time, aux_space, reason, confidence FROM {SQL_PROGRAMS}")
def d05(spark, sf):
    return code.complexities(programs(spark, sf), "doc_id", "source_code").select("doc_id", "time", "aux_space", "reason", "confidence")


@query("d13_evidence", f"SELECT doc_id, kind <> 8 AS syntax_valid, CAST(CASE WHEN kind = 8 THEN 0 ELSE 1 END AS BIGINT) AS n_functions, CASE WHEN kind = 8 THEN ['SyntaxError'] WHEN doc_id % 3 = 0 THEN [] ELSE ['F' || doc_id % 3] END AS findings FROM {SQL_PROGRAMS}")
def d13(spark, sf):
    """A lint tool's output for each program but every third; source that doesn't parse has its syntax error alone."""
    lint = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit('[{"code": "F'), (F.col("doc_id") % 3).cast("string"), F.lit('"}]')))
    found = code.evidence(programs(spark, sf), "source_code", files.findings(lint))
    return found.select("doc_id", "syntax_valid", F.size("definitions").cast("long").alias("n_functions"), F.col("findings.code").alias("findings"))


def sql_prompt(first: str, last: str, findings: bool, counter: int = 0) -> str:
    """Tokens of an edit prompt over the lines first to last, by the estimate or, for counter 1, a token for each character and a half."""
    body = f"array_to_string(list_transform(range({first}, {last} + 1), lambda i: CAST(i AS VARCHAR) || ': ' || l[i]), chr(10))"
    told = " || CASE WHEN k > 0 THEN chr(10) || chr(10) || '### Findings' || chr(10) || 'E1 at line 1' || CASE WHEN k > 1 THEN chr(10) || 'W2 at line ' || line ELSE '' END ELSE '' END" if findings else ""
    fixed = f"'### Source' || chr(10) || '{T.CODE_START}' || chr(10) || replace(replace({body}, '<<<', '<\\<<'), '>>>', '>\\>>') || chr(10) || '{T.CODE_END}'"
    return f"CAST(greatest(1, ceil(length({fixed}{told}) / {('3.5::DOUBLE * 1.15::DOUBLE', '1.5::DOUBLE')[counter]})) AS BIGINT)"


SQL_FIRST, SQL_LAST = "CASE WHEN n > 30 THEN greatest(1, line - 15) ELSE 1 END", "CASE WHEN n > 30 THEN least(n, line + 15) ELSE n END"


@query("d19_edit_context", f"""
WITH v AS (SELECT doc_id, {SQL_LINES} AS l FROM documents), w AS (SELECT *, len(l) AS n, doc_id % greatest(len(l), 1) + 1 AS line, doc_id % 3 AS k FROM v),
t AS (SELECT doc_id, {sql_prompt('1', 'n', True)} AS a, {sql_prompt(SQL_FIRST, SQL_LAST, True)} AS b, {sql_prompt(SQL_FIRST, SQL_LAST, False)} AS c FROM w)
SELECT doc_id, CASE WHEN a <= 400 THEN 'full source' WHEN b <= 400 THEN 'around the fault' WHEN c <= 400 THEN 'without findings' END AS name, CASE WHEN a <= 400 THEN a WHEN b <= 400 THEN b WHEN c <= 400 THEN c END AS tokens FROM t""")
def d19(spark, sf):
    """Edit prompts of whole texts, the fault on some line of the text and 0 to 2 findings; name and tokens are null where even the last step is too large."""
    from ..operators import context

    total = F.greatest(F.size("lines").cast("long"), F.lit(1))
    found = F.array(F.struct(F.lit("E1").alias("code"), F.lit(1).cast("long").alias("line")), F.struct(F.lit("W2").alias("code"), F.col("line").alias("line")))
    own = docs(spark, sf).select("doc_id", "text", T.lines("text").alias("lines")).withColumn("line", F.pmod("doc_id", total) + 1)
    own = own.withColumn("findings", F.slice(found, F.lit(1), F.pmod("doc_id", F.lit(3)).cast("int")))
    made = own.select("doc_id", context.edit(F.col("text"), F.col("lines"), F.col("line"), F.col("findings"), F.lit(400)).alias("c"))
    names = F.array(*map(F.lit, ("full source", "around the fault", "without findings")))
    return made.select("doc_id", F.get(names, F.size("c.omitted")).alias("name"), "c.tokens")


@query("d18_diagnosis_context")
def d18(spark, sf):
    """Prompts of generated programs under a budget that some exceed; tests hold the steps against a plain statement."""
    from ..operators import context

    own = programs(spark, sf).select(
        "doc_id", F.col("target_file").alias("path"), T.lines(F.concat("source_code", F.repeat(F.lit("# filler line of the file\n"), (F.col("doc_id") % 40).cast("int")))).alias("lines"),
        F.col("category").alias("error"), F.array(T.evidence_id("runtime", F.col("category"))).alias("error_ids"), F.col("fault_line").alias("line"),
        F.array(F.struct(F.col("fault_line").alias("line"), F.lit("main").alias("function"), F.col("faulty").alias("code"), F.lit(True).alias("is_target"))).alias("frames"),
        F.array(F.struct(F.lit("E1").alias("code"), F.lit(1).cast("long").alias("line"), F.lit("first line").alias("message"))).alias("findings"),
        F.expr("cast(array() as array<struct<name:string,start:bigint,end:bigint>>)").alias("functions"), F.expr("cast(array() as array<struct<name:string,start:bigint,end:bigint>>)").alias("classes"),
    )
    return context.diagnosis(own, F.lit(260)).select("doc_id", "context.tokens", "context.omitted", "context.start", "context.end", "context.manifest")


@query("w08_tracebacks", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'KeyError' WHEN 'click' THEN 'pkg.CustomError' WHEN 'purchase' THEN 'ValueError' END AS type, CASE event_type WHEN 'view' THEN '''k''' WHEN 'click' THEN 'first second' WHEN 'purchase' THEN '' END AS message,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CASE WHEN event_type = 'click' THEN '/lib/other.py' ELSE 'main.py' END END AS file, CASE event_type WHEN 'view' THEN greatest(1, user_id) WHEN 'click' THEN 7 WHEN 'purchase' THEN NULL END AS line,
  CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS BIGINT) AS n_frames FROM events""")
def w08(spark, sf):
    n = F.col("user_id").cast("string")
    view = F.concat(F.lit('Traceback (most recent call last):\n  File "/tmp/x/main.py", line '), n, F.lit(', in <module>\n    run()\n    ^^^^^\n  File "/lib/other.py", line 9, in run\n    d[k]\nKeyError: \'k\'\n'))
    click = F.lit('  File "/lib/other.py", line 7, in f\n    boom\n  [Previous line repeated 3 more times]\npkg.CustomError: first\n  second\n')
    err = F.when(F.col("event_type") == "view", view).when(F.col("event_type") == "click", click).when(F.col("event_type") == "purchase", "ValueError\n").otherwise("")
    outputs = table(spark, sf, "events").select("event_id", err.alias("stderr"), F.lit("main.py").alias("target"))
    return tracebacks.tracebacks(outputs, "event_id", "stderr", "target")


@query("f12_glyph_fallback", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[OK] a->b ?... ' ELSE '' END || regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS shown FROM documents")
def f12(spark, sf):
    put = F.concat(F.when(F.col("doc_id") % 2 == 0, "✓ a→b 漢… ").otherwise(""), "text")
    return docs(spark, sf).select("doc_id", code.glyphs(put, "ascii").alias("shown"))


@query("f05_encodings", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-1' WHEN 2 THEN 'utf-8' END AS name, doc_id % 4 = 2 AS marked FROM documents")
def f05(spark, sf):
    forms = F.array(*map(F.lit, [b"x = 1\n", b"# -*- coding: latin-1 -*-\n\xe9", b"\xef\xbb\xbfx", b"# coding: utf-8\n\xff"]))
    return docs(spark, sf).select("doc_id", code.encoding(F.get(forms, (F.col("doc_id") % 4).cast("int"))).alias("e")).select("doc_id", "e.*")


@query("f18_language", f"""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unsupported' ELSE 'python' END AS language, CASE WHEN doc_id % 7 = 0 THEN 'UNSUPPORTED' WHEN {KIND} = 8 THEN 'PROBABLE' ELSE 'CERTAIN' END AS confidence,
  CASE WHEN doc_id % 7 = 0 THEN 'other extension' WHEN {KIND} = 8 THEN 'syntax error' ELSE 'parses' END AS reason FROM documents""")
def f18(spark, sf):
    path = F.when(F.col("doc_id") % 7 == 0, "page.HTML").otherwise(F.col("target_file"))
    return programs(spark, sf).select("doc_id", code.language(path, F.col("source_code")).alias("l")).select("doc_id", "l.*")


@query("f25_unified_diff", """
SELECT doc_id, CAST(1 AS BIGINT) AS added, CAST(1 AS BIGINT) AS removed, '--- a/file.py' AS head FROM documents""")
def f25(spark, sf):
    own = programs(spark, sf).withColumn("after", F.replace(F.col("source_code"), F.col("faulty"), F.col("fixed")))
    d = own.select("doc_id", T.lines(F.replace(code.diff(F.col("source_code"), F.col("after")), F.lit("\r"), F.lit(""))).alias("l"))
    starts = lambda p, no: F.size(F.filter("l", lambda x: x.startswith(p) & ~x.startswith(no))).cast("long")
    return d.select("doc_id", starts("+", "+++").alias("added"), starts("-", "---").alias("removed"), F.get("l", F.lit(0)).alias("head"))


@query("f31_strict_schema", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['unknown extra'] WHEN 2 THEN ['missing rationale', 'type of bug_description', 'value of confidence'] ELSE ['not JSON'] END AS errors FROM documents""")
def f31(spark, sf):
    good = '{"bug_description": "b", "root_cause": "r", "confidence": "HIGH", "cited_evidence_ids": ["x"], "rationale": "w"}'
    forms = F.array(*map(F.lit, [good, good[:-1] + ', "extra": 1}', '{"bug_description": 3, "root_cause": "r", "confidence": "SURE", "cited_evidence_ids": []}', "{oops"]))
    return docs(spark, sf).select("doc_id", code.schema_errors(F.get(forms, (F.col("doc_id") % 4).cast("int")), "diagnosis").alias("errors"))


NAMES = "['O(1)', 'O(log n)', 'O(n)', 'O(n log n)', 'O(n²)', 'O(n³)', 'O(2^n)', 'O(nm)', 'UNKNOWN']"


@query("a15_cost_sum", f"""
WITH c AS (SELECT user_id, list(event_id % 8 ORDER BY event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_prepend(0, l), lambda a, b: CASE WHEN a = 8 OR b = 8 THEN 8 WHEN a = b THEN a WHEN a = 7 THEN CASE WHEN b <= 2 THEN 7 WHEN b >= 4 THEN b ELSE 8 END WHEN b = 7 THEN CASE WHEN a <= 2 THEN 7 WHEN a >= 4 THEN a ELSE 8 END ELSE greatest(a, b) END) AS r FROM c)
SELECT user_id, ({NAMES})[r + 1] AS total FROM f""")
def a15(spark, sf):
    name = F.get(F.array(*map(F.lit, costs.CLASSES)), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf, "events").groupBy("user_id").agg(costs.sum_aggregate(F.col("event_id"), name).alias("total"))


@query("a16_cost_product", f"""
WITH e AS (SELECT event_id, event_id % 9 AS a, user_id % 9 AS b, event_id % 2 = 0 AS d FROM events)
SELECT event_id, CASE WHEN a = 8 OR b = 8 THEN 'UNKNOWN' WHEN a = 0 THEN ({NAMES})[b + 1] WHEN b = 0 THEN ({NAMES})[a + 1] WHEN a + b = 3 AND a * b = 2 THEN 'O(n log n)'
  WHEN a = 2 AND b = 2 THEN CASE WHEN d THEN 'O(nm)' ELSE 'O(n²)' END WHEN (a = 2 AND b = 4) OR (a = 4 AND b = 2) THEN 'O(n³)' ELSE 'UNKNOWN' END AS class FROM e""")
def a16(spark, sf):
    name = lambda c: F.get(F.array(*map(F.lit, costs.CLASSES)), (F.col(c) % 9).cast("int"))
    return table(spark, sf, "events").select("event_id", costs.product_column(name("event_id"), name("user_id"), F.col("event_id") % 2 == 0).alias("class"))


@query("x01_table_function", f"SELECT doc_id, 'function' AS kind, CAST(last + pad AS BIGINT) AS end_line FROM {SQL_PROGRAMS} WHERE kind <> 8")
def x01(spark, sf):
    registry.register_functions(spark)
    programs(spark, sf).createOrReplaceTempView("tracelens_programs")
    return spark.sql("SELECT p.doc_id, d.kind, d.end AS end_line FROM tracelens_programs p, LATERAL inline(py_definitions(p.source_code)) d")


@query("t03_stream_summary", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, max(value) AS peak FROM events GROUP BY ALL""")
def t03(spark, sf):
    """Extension: the same summary over a stream of the table's files, read once; the sink keeps the last state."""
    where, state = scratch(spark, "stream"), scratch(spark, "state")
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parque[t]")
    rows = suites.windowed_summary(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "event_type <> 'error'", "value")
    write = rows.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True)
    write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(where)).start().awaitTermination()
    return spark.read.parquet(where).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "total", "passed", "peak")


@query("t03_ended_runs", """
WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value, (SELECT max(epoch_us(ts)) // 1000 FROM events) - 600000 AS seen FROM events),
b AS (SELECT *, CAST(coalesce(ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) > 36000000, true) AS INTEGER) AS b FROM e),
n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ms) AS k FROM b)
SELECT user_id AS run, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n, max(value) AS peak, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM n GROUP BY user_id, k, seen HAVING max(ms) + 36000000 < seen""")
def t03_ended(spark, sf):
    """Runs that end by ten hours of silence, from a stream of the table's files; those that the watermark has not left behind are open."""
    where, state = scratch(spark, "runs"), scratch(spark, "state")
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parque[t]")
    samples = stream.withColumns({"ts": F.col("ts").cast("timestamp"), "size": F.floor("value")})
    old = {key: spark.conf.get(key, None) for key in runs.SETTINGS}
    for key, value in runs.SETTINGS.items():
        spark.conf.set(key, value)
    try:
        out = runs.ended_runs(samples, "user_id", "ts", "value", "size", 36_000_000)
        out.writeStream.format("parquet").option("path", where).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(out.schema).parquet(where)


# --- rules of complexity, each over programs that tell its cases apart ------------------------------


def of_forms(spark, sf, sources):
    """Documents with one of the given sources each, by doc_id, behind doc_id % 5 lines of comment; ``@`` is the doc_id."""
    source = F.get(F.array(*map(F.lit, sources)), (F.col("doc_id") % len(sources)).cast("int"))
    front = F.repeat(F.lit("# a line in front\n"), (F.col("doc_id") % 5).cast("int"))
    return docs(spark, sf).select("doc_id", F.concat(front, F.replace(source, F.lit("@"), F.col("doc_id").cast("string"))).alias("source"))


def cases(values) -> str:
    """SQL CASE over doc_id modulo the number of values."""
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def classes(spark, sf, sources, *columns):
    """Target, last line and other columns of what is inferred of functions that carry their doc_id's name."""
    found = code.complexities(of_forms(spark, sf, [named(x) for x in sources]), "doc_id", "source")
    return found.select("doc_id", "target", F.col("end").alias("last"), *columns)


def named(source: str) -> str:
    return re.sub(r"\bf\(", "f@(", source)


def sql_ends(sources) -> str:
    """SQL of target and last line of each document's function."""
    return f"'f' || doc_id AS target, CAST({cases([str(len(x.splitlines())) for x in sources])} + doc_id % 5 AS BIGINT) AS last"


def names(*values) -> list[str]:
    return ["NULL" if v is None else f"'{v}'" for v in values]


@query("a14_loops_and_recursion", f"SELECT doc_id, CAST(depth AS BIGINT) AS max_depth, recursive AS any_recursion FROM {SQL_PROGRAMS} WHERE kind <> 8")
def a14(spark, sf):
    per_function = code.loop_summary(code.structure(programs(spark, sf), "doc_id", "source_code"), "doc_id")
    return per_function.groupBy("doc_id").agg(F.max("max_depth").alias("max_depth"), F.bool_or("recursive").alias("any_recursion"))


ERRORS = ["ValueError: bad @\n  worse\n", "a.b.MyError\n", "one\nKeyError: 'k'\nHello\n", "   \n", "    IndentError: deep\n"]


@query("f21_exceptions", f"SELECT doc_id, {cases(names('ValueError', 'a.b.MyError', 'Hello', None, 'IndentError'))} AS type, {cases(["'bad ' || doc_id || ' worse'", "''", "''", 'NULL', "'deep'"])} AS message FROM documents")
def f21(spark, sf):
    outputs = of_forms(spark, sf, ERRORS).withColumn("target", F.lit("main.py"))
    return tracebacks.tracebacks(outputs, "doc_id", "source", "target").select("doc_id", "type", "message")


@query("f35_normalized_findings", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE 'warning' END AS severity, CAST(1 AS BIGINT) AS start_line, CAST(greatest(1, user_id - 3) AS BIGINT) AS end_line FROM events")
def f35(spark, sf):
    level = F.when(F.col("event_id") % 3 == 0, "ERROR").when(F.col("event_id") % 3 == 1, "Info").otherwise("fatal")
    raw = F.concat(F.lit('[{"severity": "'), level, F.lit('", "location": {"row": -2}, "end_location": {"row": '), (F.col("user_id") - 3).cast("string"), F.lit("}}]"))
    return table(spark, sf, "events").select("event_id", F.get(files.findings(raw), F.lit(0)).alias("f")).select("event_id", "f.severity", "f.start_line", "f.end_line")


@query("f36_syntax_positions", f"SELECT doc_id, ({cases(['NULL', '2', '1'])} + doc_id % 5)::BIGINT AS line, {cases(['NULL', 'true', 'true'])} AS has_column FROM documents")
def f36(spark, sf):
    found = of_forms(spark, sf, ["x = 1\n", "x = 1\ny = = 2\n", "def f(:\n"]).select("doc_id", code.syntax(F.col("source")).alias("s"))
    return found.select("doc_id", "s.line", (F.col("s.col") >= 1).alias("has_column"))


@query("d06_all_functions", f"SELECT doc_id, CAST({cases(['3', '1', '1'])} AS BIGINT) AS n, {cases(['true', 'false', 'false'])} AS has_method, {cases(["'B.m' || doc_id", "'<module>'", "'<module>'"])} AS some FROM documents")
def d06(spark, sf):
    forms = ["def a(): return 1\nclass B:\n    def m@(self): return 2\n    async def n(self): return 3\n    class C:\n        def deep(self): return 4\n", "x = 1\n", ""]
    found = code.complexities(of_forms(spark, sf, forms), "doc_id", "source")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("target").contains(".")).alias("has_method"), F.max(F.when(~F.col("target").isin("a", "B.n"), F.col("target"))).alias("some"))


RECURSIVE = [
    "def f(n):\n    if n < 2:\n        return n\n    return f(n - 1) + f(n - 2)\n", "def f(n):\n    if n < 1:\n        return 0\n    return 1 + f(n // 2)\n", "def f(n):\n    if n < 1:\n        return 0\n    return n + f(n - 1)\n",
    "def f(n):\n    return f(n - 1)\n", "def f(xs):\n    if not xs:\n        return 0\n    for x in xs:\n        f(x)\n    return 1\n",
]


@query("d07_recursion", f"SELECT doc_id, {sql_ends(RECURSIVE)}, {cases(names('O(2^n)', 'O(log n)', 'O(n)', 'UNKNOWN', 'UNKNOWN'))} AS time, {cases(names('O(n)', 'O(log n)', 'O(n)', 'UNKNOWN', 'UNKNOWN'))} AS aux_space, {cases(names(None, None, None, 'DYNAMIC_RECURSION', 'DYNAMIC_RECURSION'))} AS reason FROM documents")
def d07(spark, sf):
    return classes(spark, sf, RECURSIVE, "time", "aux_space", "reason")


WHILES = [
    "def f(n):\n    while n > 1:\n        n //= 2\n", "def f(n):\n    while n > 1:\n        n //= 2\n        n = n - 1\n", "def f(a, t):\n    lo, hi = 0, len(a)\n    while lo < hi:\n        mid = lo + (hi - lo) // 2\n        if a[mid] < t:\n            lo = mid + 1\n        else:\n            hi = mid\n",
    "def f(n):\n    while True:\n        n = n >> 1\n",
]


@query("d08_halving_loops", f"SELECT doc_id, {sql_ends(WHILES)}, {cases(names('O(log n)', 'UNKNOWN', 'O(log n)', 'UNKNOWN'))} AS time, {cases(names(None, 'DYNAMIC_BOUNDS', None, 'DYNAMIC_BOUNDS'))} AS reason FROM documents")
def d08(spark, sf):
    return classes(spark, sf, WHILES, "time", "reason")


CONTAINERS = [f"def f(xs, {p}):\n    for x in xs:\n        if x in {n}:\n            return x\n" for p, n in (("seen", "seen"), ("ys: list[int]", "ys"), ("ys: set[int]", "ys"), ("lookup", "lookup"), ("other", "other"))]


@query("d09_container_kinds", f"SELECT doc_id, {sql_ends(CONTAINERS)}, {cases(names('O(n)', 'O(nm)', 'O(n)', 'O(n)', 'O(nm)'))} AS time, {cases(['true', 'false', 'true', 'true', 'false'])} AS expected FROM documents")
def d09(spark, sf):
    return classes(spark, sf, CONTAINERS, "time", "expected")


def nested(depth: int) -> str:
    return "def f(a):\n" + "".join("    " * (i + 1) + f"for x{i} in a:\n" for i in range(depth)) + "    " * (depth + 1) + "pass\n"


NESTS = [nested(1), nested(2), nested(3), nested(4), "def f(a, b):\n    for x in a:\n        for y in b:\n            pass\n", "def f(a):\n    for i in range(9):\n        for x in a:\n            pass\n"]


@query("d10_nested_loops", f"SELECT doc_id, {sql_ends(NESTS)}, {cases(names('O(n)', 'O(n²)', 'O(n³)', 'UNKNOWN', 'O(nm)', 'O(n)'))} AS time, {cases(names(None, None, None, 'DYNAMIC_BOUNDS', None, None))} AS reason FROM documents")
def d10(spark, sf):
    return classes(spark, sf, NESTS, "time", "reason")


SPACES = ["def f(a):\n    return [x for x in a]\n", "def f(a):\n    b = [x for x in a]\n    return len(b)\n", "def f(a):\n    return a[1:]\n", "def f(a):\n    yield 1\n", "def f(a):\n    a.sort()\n", "def f(a):\n    out = []\n    for x in a:\n        out.append(x)\n    return out\n"]


@query("d11_spaces", f"SELECT doc_id, {sql_ends(SPACES)}, {cases(names('O(1)', 'O(n)', 'O(1)', 'O(1)', 'O(n)', 'O(1)'))} AS aux_space, {cases(names('O(n)', 'O(1)', 'O(n)', 'O(1)', 'O(1)', 'O(n)'))} AS output_space FROM documents")
def d11(spark, sf):
    return classes(spark, sf, SPACES, "aux_space", "output_space")


CONFIDENT = ["def f(x):\n    return x + 1\n", nested(1), "def f(x):\n    return g(x)\n"]


@query("d12_confidence", f"SELECT doc_id, {sql_ends(CONFIDENT)}, {cases(names('HIGH', 'MEDIUM', 'LOW'))} AS confidence, {cases(['true', 'false', 'true'])} AS no_assumptions FROM documents")
def d12(spark, sf):
    return classes(spark, sf, CONFIDENT, "confidence", (F.size("assumptions") == 0).alias("no_assumptions"))
