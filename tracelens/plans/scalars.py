"""Scalar functions applied to whole tables.

``documents`` plays the part of target files; what its invented prose lacks (carriage returns, control characters,
markers) is put in by the same expression on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table

#: Line ends by doc_id: as they are, CRLF, a bare CR at the end, CRLF and a last LF.
VARIED = "case doc_id % 4 when 0 then text when 1 then replace(text, chr(10), chr(13) || chr(10)) when 2 then text || chr(13) else replace(text, chr(10), chr(13) || chr(10)) || chr(10) end"
SQL_LINES = r"(CASE WHEN text = '' THEN [] ELSE list_filter(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]'), lambda x, i: x <> '' OR i < len(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]'))) END)"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("f01_estimate_tokens", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 3.5::DOUBLE * 1.15::DOUBLE)) END AS BIGINT) AS tokens FROM documents")
def f01(spark, sf):
    return docs(spark, sf).select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query("f02_count_tokens", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5::DOUBLE + 0.5::DOUBLE)) END AS BIGINT) AS tokens FROM documents")
def f02(spark, sf):
    return docs(spark, sf).select("doc_id", T.count_tokens("text").alias("tokens"))


@query("f03_newline_style", f"""
WITH v AS (SELECT doc_id, {VARIED} AS t FROM documents),
c AS (SELECT doc_id, t, len(string_split(t, chr(13) || chr(10))) - 1 AS p, len(string_split(t, chr(10))) - 1 AS lf, len(string_split(t, chr(13))) - 1 AS cr FROM v)
SELECT doc_id, CASE WHEN cr > p OR (p > 0 AND lf > p) THEN 'mixed' WHEN p > 0 THEN chr(13) || chr(10) ELSE chr(10) END AS style,
       right(t, 1) IN (chr(10), chr(13)) AS trailing FROM c""")
def f03(spark, sf):
    v = docs(spark, sf).select("doc_id", F.expr(VARIED).alias("t"))
    return v.select("doc_id", T.newline_style("t").alias("style"), T.has_trailing_newline("t").alias("trailing"))


@query("f04_trailing_newline", f"SELECT doc_id, right({VARIED}, 1) IN (chr(10), chr(13)) AS trailing FROM documents")
def f04(spark, sf):
    return docs(spark, sf).select("doc_id", T.has_trailing_newline(F.expr(VARIED)).alias("trailing"))


@query("f05_bom", "SELECT doc_id, doc_id % 3 = 0 AS bom FROM documents")
def f05(spark, sf):
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("﻿"), "text")).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", T.has_bom(marked.cast("binary")).alias("bom"))


@query("f06_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def f06(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("f07_line_table", f"SELECT doc_id, CAST(i AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, {SQL_LINES} AS l FROM documents) AS s, unnest(range(1, len(l) + 1)) AS t(i)")
def f07(spark, sf):
    at = docs(spark, sf).select("doc_id", F.posexplode(T.lines("text")).alias("i", "line"))
    return at.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@query("f08_line_count", f"SELECT doc_id, CAST(len({SQL_LINES}) AS BIGINT) AS n_lines FROM documents")
def f08(spark, sf):
    return docs(spark, sf).select("doc_id", T.line_count("text").alias("n_lines"))


@query("f09_numbered_excerpt", f"""
SELECT doc_id, coalesce(array_to_string(list_transform(range(greatest(1, least(2, len(l))), least(4, len(l)) + 1), lambda i: CAST(i AS VARCHAR) || ': ' || l[i]), chr(10)), '') AS excerpt
FROM (SELECT doc_id, {SQL_LINES} AS l FROM documents)""")
def f09(spark, sf):
    return docs(spark, sf).select("doc_id", T.numbered_excerpt("text", 2, 4).alias("excerpt"))


@query("f10_find_snippet_line", f"""
SELECT doc_id, CAST(nullif(list_position(list_transform(l, lambda x: trim(x, ' ')), trim(l[least(2, len(l))], ' ')), 0) AS BIGINT) AS line_no
FROM (SELECT doc_id, {SQL_LINES} AS l FROM documents)""")
def f10(spark, sf):
    """The second line, else the only one, with spaces around it; they alone are stripped. A text without lines has none."""
    own = docs(spark, sf).withColumn("l", T.lines("text"))
    snippet = F.concat(F.lit("  "), F.get("l", F.least(F.lit(2), F.size("l")) - 1), F.lit("  \nmore"))
    return own.select("doc_id", T.find_snippet_line("text", snippet, F.trim).alias("line_no"))


DIRTY = "chr(27) || '[31m' || text || chr(27) || '[0m' || chr(13) || chr(10) || chr(7) || chr(27) || ']0;title' || chr(7) || 'end' || chr(13)"


@query("f11_sanitize", "SELECT doc_id, text || chr(10) || 'end' || chr(10) AS clean FROM documents")
def f11(spark, sf):
    return docs(spark, sf).select("doc_id", T.sanitize(F.expr(DIRTY)).alias("clean"))


@query("f13_escape_delimiters", r"""
SELECT doc_id, '<\<<BEGIN UNTRUSTED TARGET SOURCE CODE>\>>' || text || '<\<<<>\>>>' AS safe FROM documents""")
def f13(spark, sf):
    put = F.concat(F.lit(T.CODE_START), "text", F.lit("<<<<>>>>"))
    return docs(spark, sf).select("doc_id", T.escape_delimiters(put).alias("safe"))


@query("f14_wrap_untrusted", "SELECT doc_id, '<<<BEGIN UNTRUSTED TARGET SOURCE CODE>>>' || chr(10) || replace(replace(text, '<<<', '<\\<<'), '>>>', '>\\>>') || chr(10) || '<<<END UNTRUSTED TARGET SOURCE CODE>>>' AS wrapped FROM documents")
def f14(spark, sf):
    return docs(spark, sf).select("doc_id", T.wrap_untrusted("text").alias("wrapped"))


@query("f15_normalize_exponents", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'O(n^2)' WHEN 1 THEN 'O(n^3)' END AS class FROM documents")
def f15(spark, sf):
    put = F.when(F.col("doc_id") % 3 == 0, "O(n²)").when(F.col("doc_id") % 3 == 1, "O(n³)")
    return docs(spark, sf).select("doc_id", T.normalize_exponents(put).alias("class"))


@query("f16_shebang", """
SELECT doc_id, doc_id % 4 <> 3 AS has, CASE doc_id % 4 WHEN 0 THEN 'python3' WHEN 1 THEN 'bash' WHEN 2 THEN 'pythonw' END AS interpreter,
       doc_id % 4 IN (0, 2) AS is_python FROM documents""")
def f16(spark, sf):
    head = F.element_at(F.array(*map(F.lit, ["#!/usr/bin/env -S python3 -u\n", "#!/bin/bash\n", "#! C:/x/PythonW.exe\n", "# plain\n"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, sf).select("doc_id", T.shebang(F.concat(head, "text")).alias("s")).select("doc_id", "s.*")


@query("f17_binary", "SELECT doc_id, doc_id % 5 = 0 AND length(text) < 8000 AND strlen(text) < 8192 AS is_binary FROM documents")
def f17(spark, sf):
    put = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\x00"))).otherwise(F.col("text").cast("binary"))
    found = docs(spark, sf).select("doc_id", F.length("text").alias("n"), T.is_binary(put).alias("b"))
    return found.select("doc_id", (F.col("b") & (F.col("n") < 8000)).alias("is_binary"))


@query("f18_markup", "SELECT page_id, regexp_matches(lower(html), '^\\s*(<!doctype html|<html|<\\?xml|<\\?php)') AS is_markup FROM pages")
def f18(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.is_markup("html").alias("is_markup"))


@query("f19_paths", r"""
SELECT page_id, regexp_extract(regexp_replace(url, '[/\\]+$', ''), '([^/\\]*)$', 1) AS base,
       lower(regexp_extract(regexp_extract(regexp_replace(url, '[/\\]+$', ''), '([^/\\]*)$', 1), '^.+(\.[^.]+)$', 1)) AS ext, replace(url, '\', '/') AS posix FROM pages""")
def f19(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.basename("url").alias("base"), T.extension("url").alias("ext"), T.posix_path("url").alias("posix"))


@query("f20_frame_fields", """
SELECT event_id, '/srv/' || event_type || '.py' AS file, greatest(1, user_id) AS line, CASE WHEN event_id % 2 = 0 THEN 'run_' || CAST(user_id AS VARCHAR) ELSE '<module>' END AS function FROM events""")
def f20(spark, sf):
    line = F.concat(F.lit('  File "/srv/'), "event_type", F.lit('.py", line '), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(", in run_"), F.col("user_id").cast("string"))).otherwise(""))
    return table(spark, sf, "events").select("event_id", T.frame_fields(line).alias("f")).select("event_id", "f.*")


@query("f22_same_signature", """
WITH e AS (SELECT event_id, user_id, event_type, value, lag(event_type) OVER w AS p, lag(user_id % 3) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, coalesce(event_type = p AND user_id % 3 = q, false) AS same FROM e""")
def f22(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    sig = F.struct(F.col("event_type").alias("type"), (F.col("user_id") % 3).cast("string").alias("message"), F.concat(F.lit("/a/"), F.lit("x.py")).alias("file"))
    return table(spark, sf, "events").select("event_id", "user_id", sig.alias("a")).withColumn("b", F.lag("a").over(w)).select("event_id", T.same_signature(F.col("a"), F.col("b")).alias("same"))


@query("f23_line_references", """
SELECT doc_id, [doc_id % 50, doc_id % 7, doc_id % 7 + 3] AS lines FROM documents""")
def f23(spark, sf):
    k, j = (F.col("doc_id") % 50).cast("string"), F.col("doc_id") % 7
    prose = F.concat(F.lit("Bug at Line "), k, F.lit("; see lines "), j.cast("string"), F.lit(" to "), (j + 3).cast("string"), F.lit(". Outline 9."))
    return docs(spark, sf).select("doc_id", T.line_references(prose).alias("lines"))


@query("f24_evidence_lines", "SELECT doc_id, [doc_id % 9, doc_id % 5, 88] AS lines FROM documents")
def f24(spark, sf):
    put = F.concat(F.lit("ruff:F841:line_"), (F.col("doc_id") % 9).cast("string"), F.lit(" source:lines_"), (F.col("doc_id") % 5).cast("string"), F.lit("-88"))
    return docs(spark, sf).select("doc_id", T.evidence_lines(put).alias("lines"))


@query("f27_reassemble", f"""
WITH v AS (SELECT doc_id, {SQL_LINES} AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN '' WHEN doc_id % 2 = 0 THEN replace(array_to_string(l, chr(10)) || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END, chr(10), chr(13) || chr(10))
       ELSE array_to_string(l, chr(10)) || CASE WHEN doc_id % 3 = 0 THEN chr(10) ELSE '' END END AS whole FROM v""")
def f27(spark, sf):
    style = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("mixed")
    return docs(spark, sf).select("doc_id", T.reassemble(T.lines("text"), style, F.col("doc_id") % 3 == 0, F.lit(False)).alias("whole"))


@query("f29_raw_json", "SELECT event_id, event_id % 4 IN (0, 3) AS ok FROM events")
def f29(spark, sf):
    forms = F.array("props", F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat("props", F.lit(" hope this helps")), F.concat(F.lit("  "), "props", F.lit("\n")))
    return table(spark, sf, "events").select("event_id", T.is_raw_json(F.get(forms, (F.col("event_id") % 4).cast("int"))).alias("ok"))


def chats(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return turns


@query("f30_chatml", """
SELECT conv_id, coalesce(string_agg(CASE WHEN role IN ('system', 'user') THEN '<|im_start|>' || role || chr(10) || text || '<|im_end|>' END, chr(10) ORDER BY turn, role, text), '') || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
       coalesce(last(text ORDER BY turn, role, text) FILTER (role = 'assistant') || '<|im_end|>' || chr(10), '') AS completion
FROM conversations GROUP BY conv_id""")
def f30(spark, sf):
    return chats(spark, sf).select("conv_id", T.chatml_prompt("messages").alias("prompt"), T.chatml_completion("messages").alias("completion"))


@query("f32_identifier_keys", "SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def f32(spark, sf):
    put = F.when(F.col("event_id") % 3 == 0, '{"a b": 1}').otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", T.is_identifier_keys(F.json_object_keys(put)).alias("ok"))


@query("f33_json_depth", "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 4 END AS BIGINT) AS depth FROM events")
def f33(spark, sf):
    forms = F.array("props", F.concat(F.lit('{"x]": ['), "user_id", F.lit(", {}, []]}")), F.lit("{ }"), F.concat(F.lit("[["), "props", F.lit("]]")))
    return table(spark, sf, "events").select("event_id", T.json_depth(F.get(forms, (F.col("event_id") % 4).cast("int"))).alias("depth"))


@query("f34_selector", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a.py' WHEN 1 THEN 'a.py' END AS file, CASE doc_id % 6 WHEN 0 THEN 'Box' WHEN 2 THEN 'A.B' END AS class_name,
       CASE doc_id % 6 WHEN 0 THEN 'add' WHEN 1 THEN 'run' WHEN 2 THEN 'c' END AS function,
       CASE doc_id % 6 WHEN 3 THEN 'many separators' WHEN 4 THEN 'missing file' WHEN 5 THEN 'not an identifier' END AS error FROM documents""")
def f34(spark, sf):
    forms = F.array(*map(F.lit, ["a.py::Box.add", " a.py :: run ", "A.B.c", "a::b::c", "::f", "a.py::2x"]))
    return docs(spark, sf).select("doc_id", T.selector(F.get(forms, (F.col("doc_id") % 6).cast("int"))).alias("s")).select("doc_id", "s.*")


@query("f37_prompt_sections", """
SELECT doc_id, '### Target' || chr(10) || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '### Language' || chr(10) || lang ELSE '' END || chr(10) || chr(10) || '### Code' || chr(10) || text AS prompt FROM documents""")
def f37(spark, sf):
    return docs(spark, sf).select("doc_id", T.sections(("Target", F.col("source")), ("Language", F.col("lang"), F.col("doc_id") % 2 == 0), ("Code", F.col("text"))).alias("prompt"))


@query("f38_correction_prompt", """
SELECT doc_id, 'Your previous edit proposal failed validation.' || chr(10) || 'Errors:' || chr(10) || '- ' || source || chr(10) || '- ' || lang || chr(10) || 'Return one corrected JSON object and nothing else.' AS prompt FROM documents""")
def f38(spark, sf):
    return docs(spark, sf).select("doc_id", T.correction_prompt("edit", F.array("source", "lang")).alias("prompt"))


@query("f39_evidence_ids", """
SELECT doc_id, ['runtime:' || source, 'traceback:line_' || CAST(doc_id AS VARCHAR), 'source:lines_1-' || CAST(n_chars AS VARCHAR), 'ruff:E' || CAST(doc_id % 9 AS VARCHAR) || ':line_' || CAST(doc_id AS VARCHAR)] AS ids FROM documents""")
def f39(spark, sf):
    n = F.col("doc_id")
    made = F.array(
        T.evidence_id("runtime", F.col("source")), T.evidence_id("traceback", n), T.evidence_id("traceback", n), T.evidence_id("source", F.lit(1), F.col("n_chars")),
        T.evidence_id("ruff", F.concat(F.lit("E"), (n % 9).cast("string")), n),
    )
    return docs(spark, sf).select("doc_id", F.array_distinct(made).alias("ids"))


@query("f40_loss_labels", """
SELECT doc_id, list_slice(list_concat(list_transform(range(0, doc_id % 4), lambda x: CAST(-100 AS BIGINT)), range(0, doc_id % 5)), 1, 6) AS labels FROM documents""")
def f40(spark, sf):
    ids = lambda n: F.expr(f"if({n} = 0, cast(array() as array<bigint>), sequence(0L, {n} - 1L))")
    return docs(spark, sf).select("doc_id", T.loss_labels(ids("doc_id % 4"), ids("doc_id % 5"), 6).alias("labels"))


@query("f41_pad_batch", """
WITH b AS (SELECT doc_id, doc_id // 8 AS batch, range(0, doc_id % 5) AS ids FROM documents), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM b)
SELECT doc_id, batch, list_concat(ids, list_transform(range(0, n - len(ids)), lambda x: CAST(0 AS BIGINT))) AS ids FROM m""")
def f41(spark, sf):
    from pyspark.sql import Window

    b = docs(spark, sf).select("doc_id", F.expr("doc_id div 8").alias("batch"), F.expr("if(doc_id % 5 = 0, cast(array() as array<bigint>), sequence(0L, doc_id % 5 - 1L))").alias("ids"))
    return b.select("doc_id", "batch", T.pad_right(F.col("ids"), F.max(F.size("ids")).over(Window.partitionBy("batch"))).alias("ids"))
