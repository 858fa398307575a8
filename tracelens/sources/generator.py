"""Synthetic instruction pairs: a range of ordinals joined with dimensions of templates.

The choice of a template is ``ordinal % 10`` and, of its variants, ``ordinal / 10`` modulo their number; names carry the ordinal and ``ordinal % 4``
lines of comment stand first, so rows differ, and are the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Of each kind of fault its variants: name, source, faulty line, corrected line. ``@`` stands for the ordinal.
FAULTS = {
    "ZeroDivisionError": [
        ("ratio", "def ratio_@(values):\n    total = sum(values)\n    return total / len([])\n", "    return total / len([])", "    return total / max(1, len(values))"),
        ("share", "def share_@(part, whole):\n    scale = 100\n    return scale * part / whole\n", "    return scale * part / whole", "    return scale * part / whole if whole else 0"),
        ("slot", "def slot_@(index, size):\n    return index % size\n", "    return index % size", "    return index % max(1, size)"),
        ("spread", "def spread_@(value, low, high):\n    width = high - low\n    return (value - low) / width\n", "    return (value - low) / width", "    return (value - low) / width if width else 0.0"),
        ("rates", "def rates_@(counts, seconds):\n    out = []\n    for c in counts:\n        out.append(c / seconds)\n    return out\n", "        out.append(c / seconds)", "        out.append(c / max(1, seconds))"),
    ],
    "IndexError": [
        ("walk", "def walk_@(items):\n    total = 0\n    for i in range(len(items) + 1):\n        total += items[i]\n    return total\n", "    for i in range(len(items) + 1):", "    for i in range(len(items)):"),
        ("last", "def last_@(items):\n    return items[len(items)]\n", "    return items[len(items)]", "    return items[len(items) - 1]"),
        ("take", "def take_@(stack):\n    top = stack.pop()\n    return top\n", "    top = stack.pop()", "    top = stack.pop() if stack else None"),
        ("steps", "def steps_@(rows):\n    total = 0\n    for i in range(len(rows)):\n        total += rows[i + 1] - rows[i]\n    return total\n", "    for i in range(len(rows)):", "    for i in range(len(rows) - 1):"),
    ],
    "KeyError": [
        ("pick", "def pick_@(lookup, key):\n    found = lookup[key]\n    return found\n", "    found = lookup[key]", "    found = lookup.get(key)"),
        ("tally", "def tally_@(words):\n    lookup = {}\n    for w in words:\n        lookup[w] += 1\n    return lookup\n", "        lookup[w] += 1", "        lookup[w] = lookup.get(w, 0) + 1"),
        ("deep", "def deep_@(config):\n    return config['a']['b']\n", "    return config['a']['b']", "    return config.get('a', {}).get('b')"),
    ],
    "TypeError": [
        ("label", "def label_@(name, count):\n    return name + count\n", "    return name + count", "    return name + str(count)"),
        ("bill", "def bill_@(prices):\n    out = ''\n    for p in prices:\n        out = out + p\n    return out\n", "        out = out + p", "        out = out + str(p)"),
        ("call", "def call_@(value):\n    return value(3)\n", "    return value(3)", "    return value * 3"),
        ("cell", "def cell_@(grid):\n    row = None\n    return row[0]\n", "    row = None", "    row = grid[0]"),
    ],
    "AttributeError": [
        ("grow", "def grow_@(items):\n    out = []\n    for x in items:\n        out.push(x)\n    return out\n", "        out.push(x)", "        out.append(x)"),
        ("trim", "def trim_@(name):\n    found = None\n    return found.strip()\n", "    found = None", "    found = name"),
        ("first", "def first_@(rows):\n    return rows.first\n", "    return rows.first", "    return rows[0]"),
    ],
    "ValueError": [
        ("parse", "def parse_@(text):\n    return int(text + '!')\n", "    return int(text + '!')", "    return int(text)"),
        ("halves", "def halves_@(items):\n    left, right = items\n    return left\n", "    left, right = items", "    left, right = items[0], items[1]"),
        ("find", "def find_@(items, wanted):\n    return items.index(wanted)\n", "    return items.index(wanted)", "    return items.index(wanted) if wanted in items else -1"),
    ],
    "NameError": [
        ("area", "def area_@(width, height):\n    return widht * height\n", "    return widht * height", "    return width * height"),
        ("merge", "def merge_@(parts):\n    for part in parts:\n        result = part\n    return reslt\n", "    return reslt", "    return result"),
    ],
    "RecursionError": [
        ("down", "def down_@(n):\n    return n + down_@(n - 1)\n", "    return n + down_@(n - 1)", "    return n + down_@(n - 1) if n > 0 else 0"),
    ],
    "SyntaxError": [
        ("open", "def open_@(a, b:\n    return a + b\n", "def open_@(a, b:", "def open_@(a, b):"),
        ("gap", "def gap_@(a)\n    return a\n", "def gap_@(a)", "def gap_@(a):"),
    ],
    "logic_bug": [
        ("pairs", "def pairs_@(left, right):\n    n = 0\n    for a in left:\n        for b in right:\n            n += 2\n    return n\n", "            n += 2", "            n += 1"),
        ("best", "def best_@(items):\n    best = 0\n    for x in items:\n        if x < best:\n            best = x\n    return best\n", "        if x < best:", "        if x > best:"),
        ("search", "def search_@(items, wanted):\n    lo, hi = 0, len(items)\n    while lo < hi:\n        mid = (lo + hi) // 2\n        if items[mid] < wanted:\n            lo = mid\n        else:\n            hi = mid\n    return lo\n", "            lo = mid", "            lo = mid + 1"),
        ("fact", "def fact_@(n):\n    if n < 1:\n        return 0\n    return n * fact_@(n - 1)\n", "        return 0", "        return 1"),
    ],
}
#: Cases without a fault to name: category, name, source, reason to abstain.
NO_FAULTS = [
    ("clean_code", "total", "def total_@(items):\n    out = 0\n    for x in items:\n        out += x\n    return out\n", "UNGROUNDED_EVIDENCE"),
    ("external_dependency", "fetch", "import requests\n\n\ndef fetch_@(url):\n    return requests.get(url)\n", "UNGROUNDED_EVIDENCE"),
    ("out_of_bounds", "tiny", "def tiny_@(x):\n    return x\n", "OUT_OF_BOUNDS_LINES"),
    ("prompt_budget_exceeded", "wide", "def wide_@(x):\n" + "    x = x + 1  # one more of very many lines\n" * 150 + "    return x\n", "PROMPT_BUDGET_EXCEEDED"),
]
KINDS = tuple(FAULTS)
#: Number of variants of each kind.
VARIANTS = tuple(len(v) for v in FAULTS.values())
COMMENT = "# generated file\n"
TASKS = (("diagnosis", "ft_diag"), ("edit_proposal", "ft_edit"), ("abstention", "ft_abst"))


def counts(total: int) -> tuple[int, int, int]:
    """Pairs of each task: 41 % each of diagnoses and edits, rounded down, and the rest."""
    part = int(total * 0.41)
    return part, part, total - 2 * part


def templates(spark: SparkSession) -> DataFrame:
    rows = [(k, v, kind, *t) for k, (kind, own) in enumerate(FAULTS.items()) for v, t in enumerate(own)]
    return spark.createDataFrame(rows, "kind_no int, variant int, category string, stem string, template string, faulty string, fixed string")


def filled(template: str) -> Column:
    """A template column with the ordinal in place of ``@``."""
    return F.replace(F.col(template), F.lit("@"), F.col("ordinal").cast("string"))


def source_of(template: str) -> Column:
    return F.concat(F.repeat(F.lit(COMMENT), F.pmod("ordinal", F.lit(4)).cast("int")), filled(template))


def file_of(stem: str) -> Column:
    return F.concat(stem, F.lit("_"), F.col("ordinal").cast("string"), F.lit(".py"))


def sources(spark: SparkSession, ordinals: DataFrame) -> DataFrame:
    """Adds category, variant, target_file, source_code, fault_line, faulty and fixed line to rows with ``ordinal``."""
    kind = F.pmod("ordinal", F.lit(len(KINDS))).cast("int")
    own = ordinals.withColumn("kind_no", kind)
    own = own.withColumn("variant", F.pmod(F.floor(F.col("ordinal") / len(KINDS)), F.get(F.array(*map(F.lit, VARIANTS)), "kind_no")).cast("int"))
    own = own.join(F.broadcast(templates(spark)), ["kind_no", "variant"])
    own = own.withColumns({"target_file": file_of("stem"), "source_code": source_of("template"), "faulty": filled("faulty"), "fixed": filled("fixed")})
    return own.withColumn("fault_line", T.find_snippet_line("source_code", "faulty")).drop("template", "stem")


def abstentions(spark: SparkSession, ordinals: DataFrame) -> DataFrame:
    """Adds category, target_file, source_code and the reason to abstain to rows with ``ordinal``."""
    dim = spark.createDataFrame([(i, *t) for i, t in enumerate(NO_FAULTS)], "case_no int, category string, stem string, template string, reason string")
    own = ordinals.withColumn("case_no", F.pmod("ordinal", F.lit(len(NO_FAULTS))).cast("int")).join(F.broadcast(dim), "case_no")
    return own.withColumns({"target_file": file_of("stem"), "source_code": source_of("template")}).drop("template", "stem", "case_no")


def pairs(spark: SparkSession, total: int) -> DataFrame:
    """``total`` instruction pairs; see ``pairs_of``."""
    return pairs_of(spark.range(total).withColumnRenamed("id", "place"), "place", total).drop("place")


def pairs_of(rows: DataFrame, place: str, total: int) -> DataFrame:
    """One instruction pair for each row, whose place (from 0, of ``total``) decides its task; all columns stay, none of which may be named like one of these: id, task_type, category, target_file, source_code, fault_line, prompt, completion, evidence_manifest, faulty and fixed line,
    token counts. Abstentions have no fault."""
    spark, (first, second, _), at = rows.sparkSession, counts(total), F.col(place)
    task = F.when(at < first, 0).when(at < first + second, 1).otherwise(2)
    placed = rows.withColumns({"task": task, "ordinal": at - F.when(task == 0, 0).when(task == 1, first).otherwise(first + second)})
    faults = sources(spark, placed.filter("task < 2")).withColumn("reason", F.lit(None).cast("string"))
    none = abstentions(spark, placed.filter("task = 2"))
    full = faults.unionByName(none, allowMissingColumns=True)
    name, prefix = (F.get(F.array(*[F.lit(t[k]) for t in TASKS]), F.col("task")) for k in (0, 1))
    told = F.when(F.col("reason").isNull(), F.concat("category", F.lit(" at line "), F.col("fault_line").cast("string"))).otherwise("no failure was recorded")
    prompt = T.sections(("Target", F.col("target_file")), ("Source", T.numbered_excerpt("source_code")), ("Failure", told))
    cited = F.array(T.evidence_id("runtime", F.col("category")), T.evidence_id("traceback", F.col("fault_line")))
    edit = F.struct(F.lit("replace").alias("operation"), F.col("fault_line").alias("start_line"), F.col("fault_line").alias("end_line"), F.col("faulty").alias("expected_text"), F.col("fixed").alias("replacement_text"))
    completion = (
        F.when(F.col("task") == 0, F.to_json(F.struct(F.concat(F.col("category"), F.lit(" in "), "target_file").alias("bug_description"), F.col("faulty").alias("root_cause"), F.lit("HIGH").alias("confidence"), cited.alias("cited_evidence_ids"), F.lit("The line fails.").alias("rationale"))))
        .when(F.col("task") == 1, F.to_json(F.struct("target_file", F.array(edit).alias("edits"), F.lit("Corrects the line.").alias("explanation"))))
        .otherwise(F.to_json(F.struct(F.col("target_file").alias("target"), "reason", F.lit("No evidence names a cause.").alias("details"))))
    )
    out = full.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.concat(prefix, F.lit("_"), F.format_string("%05d", F.col("ordinal") + 1)).alias("id"), name.alias("task_type"), "category", "target_file", "source_code", "fault_line",
        prompt.alias("prompt"), completion.alias("completion"), F.when(F.col("task") == 0, cited).alias("evidence_manifest"), "faulty", "fixed", "reason",
    )
    return out.withColumns({"prompt_tokens": T.count_tokens("prompt"), "completion_tokens": T.count_tokens("completion")}).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def missing_files(manifest: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows of a manifest whose file is not in a listing."""
    return manifest.join(listing.select(path).distinct(), path, "left_anti")


def manifest_samples(listing: DataFrame, entries: DataFrame) -> DataFrame:
    """The samples of a manifest of files, a row each: path, all other columns of its entry, and row_count, the rows of its file. An entry whose file is not listed fails.

    ``listing``: path, n_rows. ``sinks.commit`` writes them with a head that counts them; a manifest of any number of samples is never one value.
    """
    joined = entries.join(listing.select("path", F.col("n_rows").alias("row_count"), F.lit(True).alias("there")), "path", "left")
    checked = joined.withColumn("path", F.when(F.col("there"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("missing file: "), "path"))))
    return checked.select("path", *[F.col(f"`{c}`") for c in entries.columns if c != "path"], "row_count")


def expected_status(error: Column, category: Column) -> Column:
    """What a sample's command should end with, by the kind of its error and its category."""
    return (
        F.when(error.isNull(), "clean_success").when(error == "OutputOverflow", "output_overflow").when(error == "TimeoutError", "timeout")
        .when((category == "syntax_error") & error.isin("SyntaxError", "IndentationError"), "syntax_error").when(category == "logic_bug", "assertion_failure")
        .when(category == "external_dependency", "import_error").otherwise("runtime_exception")
    )
