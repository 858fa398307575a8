"""Aggregations, ordered operators, sorts and set operations over whole tables.

``events`` plays the part of recorded runs: suite = event_type, file or process = user_id, duration = value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats, windows
from .registry import query, table

PCT = "CASE WHEN count(*) > 0 THEN {} * 1.0 / count(*) * 100.0 ELSE 0.0 END"


def events(spark, sf):
    return table(spark, sf, "events")


def suites(spark, sf):
    return stats.summarize(events(spark, sf), ["event_type"], F.col("event_type") != "error", F.col("event_id") % 3 != 0, F.col("value"), F.col("user_id"))


@query("a01_suite_summary", """
SELECT event_type, count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_id % 3 <> 0) AS schema_valid, count(*) FILTER (event_type <> 'error') / count(*) * 100.0::DOUBLE AS accuracy_pct,
  count(*) FILTER (event_id % 3 <> 0) / count(*) * 100.0::DOUBLE AS schema_valid_pct, min(value) AS min_ms, max(value) AS max_ms, avg(value) AS mean_ms, median(value) AS median_ms,
  max(user_id) AS peak_bytes FROM events GROUP BY event_type""")
def a01(spark, sf):
    return suites(spark, sf)


FLAGS = {
    "first_valid": "event_id % 3 <> 0", "post_valid": "event_id % 5 <> 0", "retried": "event_id % 4 = 0", "precise": "event_type <> 'error'", "level_a": "value > 5",
    "level_b": "value > 10", "level_c": "value > 20", "level_d": "value > 40", "hallucinated": "event_type = 'signup'",
}
CARD_SQL = ("SELECT user_id % 4 AS model, count(*) AS total, " + ", ".join(
    f"count(*) FILTER ({f}) AS {k}_count, round(count(*) FILTER ({f}) / count(*) * 100.0::DOUBLE, 1) AS {k}_pct" for k, f in FLAGS.items())
    + ", round(avg(user_id % 11), 1) AS avg_diff_lines, round(min(value), 1) AS min_ms, round(max(value), 1) AS max_ms, round(avg(value), 1) AS mean_ms, round(median(value), 1) AS median_ms FROM events GROUP BY 1")


def cards(spark, sf):
    rows = events(spark, sf).withColumn("model", F.col("user_id") % 4)
    return stats.scorecard(rows, ["model"], {k: F.expr(f) for k, f in FLAGS.items()}, F.col("user_id") % 11, F.col("value"))


@query("a02_scorecard", CARD_SQL)
def a02(spark, sf):
    return cards(spark, sf)


DELTAS = ["first_valid_pct", "post_valid_pct", "retried_pct", "precise_pct", "level_a_pct", "level_b_pct", "level_c_pct", "level_d_pct"]


@query("a03_comparison", f"WITH c AS ({CARD_SQL}), b AS (SELECT * FROM c WHERE model = 0), t AS (SELECT * FROM c WHERE model = 1) SELECT "
       + ", ".join(f"round(t.{d} - b.{d}, 1) AS {d}_delta" for d in DELTAS)
       + ", CASE WHEN b.avg_diff_lines > 0 THEN round((b.avg_diff_lines - t.avg_diff_lines) / b.avg_diff_lines * 100.0::DOUBLE, 1) ELSE 0.0 END AS diff_reduction_pct, "
         "round(b.hallucinated_pct - t.hallucinated_pct, 1) AS hallucination_reduction_pct, round(t.median_ms - b.median_ms, 1) AS latency_delta_ms FROM b, t")
def a03(spark, sf):
    return stats.comparison(cards(spark, sf), "model", 0, 1, DELTAS)


@query("a04_grand_total", """
SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(total) - sum(passed) AS BIGINT) AS failed, sum(passed) / sum(total) * 100.0::DOUBLE AS accuracy_pct, bool_and(failed = 0) AS all_clean
FROM (SELECT event_type, count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)""")
def a04(spark, sf):
    return stats.grand_total(suites(spark, sf), F.col("failed") == 0)


@query("a05_timing_stats", """
SELECT user_id, count(value) AS n, median(value) AS median, min(value) AS least, max(value) AS most, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS deviation FROM events GROUP BY user_id""")
def a05(spark, sf):
    return stats.timing(events(spark, sf), ["user_id"], "value")


@query("a06_heap_stats", """
SELECT event_type, count(b) AS n, median(b) AS median, min(b) AS least, max(b) AS most, avg(b) AS mean, coalesce(stddev_samp(b), 0.0) AS deviation
FROM (SELECT event_type, CAST(floor(value * 1024) AS BIGINT) AS b FROM events) GROUP BY event_type""")
def a06(spark, sf):
    return stats.timing(events(spark, sf).withColumn("b", F.floor(F.col("value") * 1024)), ["event_type"], "b")


@query("a07_token_stats", """
SELECT lang, min(t) AS least, max(t) AS most, round(avg(t), 2) AS mean, round(median(t), 2) AS median
FROM (SELECT lang, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5::DOUBLE + 0.5::DOUBLE)) END AS BIGINT) AS t FROM documents) GROUP BY lang""")
def a07(spark, sf):
    return stats.token_stats(table(spark, sf, "documents").select("lang", T.count_tokens("text").alias("t")), ["lang"], "t")


@query("a08_frequency_tables", """
WITH c AS (SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source)
SELECT dimension, value, n, round(n / sum(n) OVER (PARTITION BY dimension) * 100.0::DOUBLE, 2) AS pct FROM c""")
def a08(spark, sf):
    return stats.frequency_tables(table(spark, sf, "documents"), ["lang", "source"])


@query("a09_split_shares", "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100.0::DOUBLE, 2) AS pct FROM documents GROUP BY lang")
def a09(spark, sf):
    return stats.shares(table(spark, sf, "documents"), "lang")


@query("a10_grouped_lists", "SELECT conv_id, list(role ORDER BY turn, role) AS items FROM conversations GROUP BY conv_id")
def a10(spark, sf):
    return stats.grouped_lists(table(spark, sf, "conversations"), ["conv_id"], "turn", "role")


@query("a11_peak_memory", """
SELECT user_id, coalesce(max(value) FILTER (event_type <> 'error'), 0.0) AS peak, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY user_id""")
def a11(spark, sf):
    return stats.peaks(events(spark, sf), ["user_id"], "value", F.col("event_type") == "error")


@query("a12_process_trees", """
WITH RECURSIVE n AS (SELECT event_id AS id, CASE WHEN event_id % 64 = 0 THEN NULL ELSE event_id - 1 - (event_id % 64) // 2 END AS parent, user_id FROM events),
t AS (SELECT id, id AS root, user_id FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.root, n.user_id FROM n JOIN t ON n.parent = t.id)
SELECT root, CAST(sum(user_id) AS BIGINT) AS total, count(*) AS n FROM t GROUP BY root""")
def a12(spark, sf):
    nodes = events(spark, sf).selectExpr("event_id as id", "if(event_id % 64 = 0, null, event_id - 1 - (event_id % 64) div 2) as parent", "user_id")
    return stats.tree_sums(nodes, "user_id")


EDIT_LINES = "greatest(l_quantity % 7, l_linenumber)"


@query("a13_changed_lines", f"""
SELECT l_orderkey, CAST(sum({EDIT_LINES}) AS BIGINT) AS changed, count(*) <= 8 AND sum({EDIT_LINES}) <= 80 AS within FROM lineitem GROUP BY l_orderkey""")
def a13(spark, sf):
    changed = F.sum(F.expr(EDIT_LINES))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(changed.cast("long").alias("changed"), ((F.count("*") <= 8) & (changed <= 80)).alias("within"))


@query("a17_validation_rates", """
WITH f AS (SELECT CASE WHEN event_id % 4 IN (0, 3) THEN 1.0 ELSE 0.0 END AS ok FROM events ORDER BY event_id LIMIT 50) SELECT coalesce(round(avg(ok), 4), 1.0) AS rate FROM f""")
def a17(spark, sf):
    forms = F.array("props", F.concat(F.lit("```"), "props"), F.concat("props", F.lit("!")), "props")
    return stats.parse_rate(events(spark, sf), "event_id", T.is_raw_json(F.get(forms, (F.col("event_id") % 4).cast("int"))))


@query("a17_mean_loss", "SELECT event_type, avg(value) FILTER (event_id % 9 <> 0) AS loss FROM events GROUP BY event_type")
def a17_loss(spark, sf):
    rows = events(spark, sf).withColumn("loss", F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return stats.mean_loss(rows, ["event_type"], "loss")


@query("a18_verdicts", "SELECT user_id, bool_and(value > 0.5) AS all_established, bool_or(event_type = 'error') AS any_broken FROM events GROUP BY user_id")
def a18(spark, sf):
    return stats.verdicts(events(spark, sf), ["user_id"], F.col("value") > 0.5, F.col("event_type") == "error")


@query("a19_distinct_in_order", "SELECT conv_id, list(role ORDER BY first, role) AS firsts FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def a19(spark, sf):
    return stats.distinct_in_order(table(spark, sf, "conversations"), ["conv_id"], "turn", "role").withColumnRenamed("items", "firsts")


@query("a20_sorted_distinct", "SELECT user_id, list_sort(list_distinct(list(event_id % 17))) AS lines FROM events GROUP BY user_id")
def a20(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_set(F.col("event_id") % 17)).alias("lines"))


@query("a21_collected_errors", """
SELECT event_id, CAST(i AS BIGINT) AS index, e[i + 1] AS error FROM (SELECT event_id, list_filter([CASE WHEN value > 40 THEN 'slow' END, CASE WHEN event_type = 'error' THEN 'failed' END], lambda x: x IS NOT NULL) AS e FROM events) AS s, unnest(range(0, len(e))) AS t(i)""")
def a21(spark, sf):
    return stats.collected_errors(events(spark, sf), "event_id", F.array_compact(F.array(F.when(F.col("value") > 40, "slow"), F.when(F.col("event_type") == "error", "failed"))))


@query("a22_output_totals", "SELECT user_id, least(2000, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT)) AS stored, sum(CAST(floor(value) AS BIGINT)) >= 2000 AS truncated FROM events GROUP BY user_id")
def a22(spark, sf):
    capped = windows.byte_cap(events(spark, sf).withColumn("size", F.floor("value")), "user_id", "event_id", "size", 2000)
    return capped.groupBy("user_id").agg(F.sum("kept").alias("stored"), F.bool_or("capped").alias("truncated"))


# --- ordered operators ----------------------------------------------------------------------------


@query("w01_stratified_split", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
h AS (SELECT *, CASE WHEN n >= 10 THEN greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT)) WHEN n >= 3 THEN 1 ELSE 0 END AS held FROM r)
SELECT doc_id, lang, CASE WHEN k <= greatest(1, n - 2 * held) THEN 'train' WHEN k <= greatest(1, n - 2 * held) + held THEN 'val' ELSE 'test' END AS split FROM h""")
def w01(spark, sf):
    return windows.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("w02_first_per_group", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 2")
def w02(spark, sf):
    return windows.first_per_group(events(spark, sf).select("event_type", "event_id"), ["event_type"], ["event_id"])


@query("w03_stride_sample", "SELECT event_id, user_id FROM events QUALIFY (row_number() OVER (ORDER BY event_id) - 1) % 3 = 0")
def w03(spark, sf):
    return windows.stride(events(spark, sf).select("event_id", "user_id"), "event_id", 3)


@query("w04_edit_order", """
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_suppkey <= lag(l_suppkey) OVER w OR l_suppkey <= lag(l_suppkey + l_linenumber) OVER w, false) AS violates
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)""")
def w04(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("ordinal", F.struct("l_linenumber", "l_partkey", "l_extendedprice")).withColumn("end", F.col("l_suppkey") + F.col("l_linenumber"))
    return windows.out_of_order(rows, "l_orderkey", "ordinal", "l_suppkey", "end").select("l_orderkey", "l_linenumber", "l_partkey", "violates")


@query("w05_byte_cap", """
WITH c AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS size, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS upto FROM events)
SELECT user_id, event_id, size, CAST(least(size, greatest(500 - (upto - size), 0)) AS BIGINT) AS kept, upto >= 500 AS capped FROM c""")
def w05(spark, sf):
    return windows.byte_cap(events(spark, sf).select("user_id", "event_id", F.floor("value").alias("size")), "user_id", "event_id", "size", 500)


@query("w06_edit_shift", """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(coalesce(sum(l_linenumber - 3) OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM lineitem""")
def w06(spark, sf):
    rows = table(spark, sf, "lineitem")
    return windows.running_shift(rows, "l_orderkey", ["l_suppkey", "l_partkey", "l_extendedprice"], F.col("l_linenumber") - 3).select("l_orderkey", "l_partkey", "l_suppkey", "shift")


@query("w09_median", "SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def w09(spark, sf):
    return stats.grouped(events(spark, sf), ["event_type"], [F.count(F.lit(1)).alias("n")], {"median": F.col("value")}).drop("n")


@query("w10_excerpt", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 + 1 END AS s, CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 + 40 END AS e, CASE WHEN doc_id % 3 <> 2 THEN doc_id % 100 + 1 END AS f, doc_id % 110 + 100 AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN s IS NOT NULL THEN s WHEN f IS NOT NULL THEN greatest(1, f - 15) ELSE 1 END AS BIGINT) AS start, CAST(least(n, CASE WHEN s IS NOT NULL THEN e WHEN f IS NOT NULL THEN f + 15 ELSE 30 END) AS BIGINT) AS "end" FROM d""")
def w10(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "if(doc_id % 3 = 0, doc_id % 90 + 1, null) as s", "if(doc_id % 3 = 0, doc_id % 90 + 40, null) as e", "if(doc_id % 3 <> 2, doc_id % 100 + 1, null) as f", "doc_id % 110 + 100 as n")
    return d.select("doc_id", windows.excerpt(F.col("s"), F.col("e"), F.col("f"), F.col("n")).alias("x")).select("doc_id", "x.*")


@query("w11_shrink_window", """
WITH RECURSIVE w AS (
  SELECT doc_id, 0 AS k, CAST(1 AS BIGINT) AS s, doc_id % 300 + 7 AS e, doc_id % 150 + 1 AS c, doc_id % 300 + 7 AS n FROM documents
  UNION ALL
  SELECT doc_id, k + 1, s2, e2, c, n FROM (SELECT *, greatest(1, c - greatest(3, (c - s) // 2)) AS s2, least(n, c + greatest(3, (e - c) // 2)) AS e2 FROM w) WHERE e - s > 6 AND (s2 <> s OR e2 <> e) AND k < 24)
SELECT doc_id, list([s, e] ORDER BY k) AS windows FROM w GROUP BY doc_id""")
def w11(spark, sf):
    n, c = F.col("doc_id") % 300 + 7, F.col("doc_id") % 150 + 1
    made = windows.shrink(F.lit(1), n, c, n)
    return table(spark, sf, "documents").select("doc_id", F.transform(made, lambda w: F.array(w["start"], w["end"])).alias("windows"))


@query("w12_ordinal_ids", "SELECT doc_id, printf('ft_diag_%05d', doc_id + 1) AS id FROM documents")
def w12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", windows.ordinal_id("ft_diag", F.col("doc_id")).alias("id"))


# --- sorts and limits -----------------------------------------------------------------------------


@query("o01_sorted_edits", "SELECT l_orderkey, list(l_suppkey ORDER BY l_suppkey, l_partkey) AS edits, list(l_suppkey ORDER BY l_suppkey DESC, l_partkey DESC) AS applied FROM lineitem GROUP BY l_orderkey")
def o01(spark, sf):
    own = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_partkey"))).alias("e"))
    return own.select("l_orderkey", F.col("e.l_suppkey").alias("edits"), F.reverse("e")["l_suppkey"].alias("applied"))


@query("o02_smallest_span", "SELECT user_id, arg_min(event_id, [user_id % 3 + event_id % 13, event_id]) AS first FROM events GROUP BY user_id")
def o02(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.min_by("event_id", F.struct(F.col("user_id") % 3 + F.col("event_id") % 13, "event_id")).alias("first"))


@query("o03_sorted_keys", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY source")
def o03(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


@query("o04_caps", "SELECT user_id, list_slice(list(event_id ORDER BY event_id), 1, 3) AS firsts FROM events GROUP BY user_id")
def o04(spark, sf):
    few = windows.first_per_group(events(spark, sf).select("user_id", "event_id"), ["user_id"], ["event_id"], 3)
    return few.groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("firsts"))


@query("o05_first_errors", "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20")
def o05(spark, sf):
    return events(spark, sf).filter("event_type = 'error'").select("event_id", "value").orderBy("event_id").limit(20)


@query("o06_first_samples", "SELECT event_id FROM events ORDER BY event_id LIMIT 10")
def o06(spark, sf):
    return events(spark, sf).select("event_id").orderBy("event_id").limit(10)


@query("o07_last_edit", "SELECT l_orderkey, arg_max(l_partkey, [l_suppkey, l_partkey]) AS last FROM lineitem GROUP BY l_orderkey")
def o07(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_suppkey", "l_partkey")).alias("last"))


@query("o08_first_function", "SELECT user_id, arg_min(event_type, event_id) AS first FROM events GROUP BY user_id")
def o08(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"))


# --- set operations -------------------------------------------------------------------------------


@query("u01_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u01(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("u02_bag_union", "SELECT doc_id, 'd' AS origin FROM documents UNION ALL SELECT doc_id, 'l' FROM labels")
def u02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lit("d").alias("origin")).unionByName(table(spark, sf, "labels").select("doc_id", F.lit("l").alias("origin")))


@query("u03_subset", "SELECT conv_id, list_has_all(list(role), ['user', 'assistant']) AS complete FROM conversations GROUP BY conv_id")
def u03(spark, sf):
    needed = F.array(F.lit("user"), F.lit("assistant"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.size(F.array_except(needed, F.collect_set("role"))) == 0).alias("complete"))


@query("u04_membership", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def u04(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("u05_list_minus_list", "SELECT user_id, list_sort(list_filter(list_distinct(list(event_id % 29)), lambda x: NOT list_contains([1, 3, 5], x))) AS rest FROM events GROUP BY user_id")
def u05(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.sort_array(F.array_except(F.collect_set(F.col("event_id") % 29), F.array(*[F.lit(x).cast("long") for x in (1, 3, 5)]))).alias("rest"))


@query("u06_findings_kept_apart", """
WITH bad AS (SELECT user_id, event_id, 'syntax' AS kind FROM events WHERE event_type = 'error' AND value > 30), lint AS (SELECT user_id, event_id, 'lint' AS kind FROM events WHERE event_type = 'view')
SELECT * FROM bad UNION ALL SELECT * FROM lint WHERE user_id NOT IN (SELECT user_id FROM bad)""")
def u06(spark, sf):
    e = events(spark, sf)
    bad = e.filter("event_type = 'error' and value > 30").select("user_id", "event_id", F.lit("syntax").alias("kind"))
    lint = e.filter("event_type = 'view'").select("user_id", "event_id", F.lit("lint").alias("kind"))
    return bad.unionByName(lint.join(bad.select("user_id").distinct(), "user_id", "left_anti"))
