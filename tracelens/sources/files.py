"""Sources: files, JSON documents, JSON Lines, lint output, profile inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import code, rules
from ..operators.scan import running

MOST_SOURCE, MOST_INPUT, DEEPEST_INPUT = 256 * 1024, 1 << 20, 20


def target_columns(path: Column, content: Column) -> list[Column]:
    """Facts of a file: size, digest, declared encoding, mark, line ends, whether it is binary."""
    text = F.decode(content, "ISO-8859-1")  # line ends are bytes, whatever the encoding
    found = code.encoding(content)
    return [
        path.alias("path"), F.octet_length(content).cast("long").alias("file_size_bytes"), F.sha2(content, 256).alias("sha256"), found["name"].alias("encoding"),
        T.has_bom(content).alias("has_bom"), T.newline_style(text).alias("newline_style"), T.has_trailing_newline(text).alias("has_trailing_newline"), T.is_binary(content).alias("is_binary"),
    ]


def scan(spark: SparkSession, paths: str | list[str], most: int = MOST_SOURCE) -> DataFrame:
    """A row of facts and content for each file of at most ``most`` bytes that decodes by its declared encoding. The size bound reaches the file listing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).filter(F.col("length") <= most)
    return found.select(*target_columns(F.col("path"), F.col("content")), "content").filter("encoding is not null")


def texts(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``text``: decoded by the declared encoding, else as UTF-8 with replacement."""
    return files.withColumn("text", code.decoded(F.col(content)))


def json_items(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Elements of the array ``field`` of JSON documents, one document for each file."""
    return spark.read.schema(f"{field} array<{schema}>").option("multiLine", True).json(path).select(F.explode(field).alias("item")).select("item.*")


def json_documents(rows: DataFrame, by: str, order: str, item: Column, head: Column, field: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Column ``value``: pretty JSON documents (head's fields, then the array ``field`` of items) of one ``by`` each, in order. A document takes items until it has
    ``most_bytes``, so it is at most an item larger, whatever a ``by`` holds."""
    text = rows.select(by, order, item.alias("__item")).withColumn("__size", F.octet_length(F.to_json("__item")))
    numbered = running(text, [by], [order], sums={"__before": F.col("__size")}, before=True)
    part = F.floor(F.col("__before") / most_bytes)
    documents = numbered.groupBy(by, part.alias("__part")).agg(F.array_sort(F.collect_list(F.struct(order, "__item")))["__item"].alias(field))
    return documents.select(F.to_json(F.struct(head, field), {"pretty": "true"}).alias("value"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str, first: int | None = None) -> DataFrame:
    """Objects of JSON Lines files; blank lines are skipped, lines that don't parse are dropped. ``first``: as many as that, where a caller wants few."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    rows = rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")
    return rows if first is None else rows.limit(first)


def splits(spark: SparkSession, folder: str, schema: str, names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Rows of all splits with their ``split``; a split that is missing is an error of the read."""
    out = None
    for name in names:
        own = json_lines(spark, f"{folder}/{name}.jsonl", schema).withColumn("split", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


ANSWERS = "sample bigint, task string, attempt int, status string, text string"
RUNS = "run_id bigint, path string, exit_code int, stdout string, stderr string, duration_seconds double, timed_out boolean"


def recorded_answers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Recorded answers of a model (JSON Lines): sample, task, attempt, status, text. An answer without a status is 'ok' if it has text, else 'unavailable'."""
    rows = json_lines(spark, path, ANSWERS)
    return rows.withColumn("status", F.coalesce("status", F.when(F.length(F.trim("text")) > 0, "ok").otherwise("unavailable")))


def recorded_runs(spark: SparkSession, path: str | list[str], most_bytes: int = MOST_INPUT, limit: float = 5.0) -> DataFrame:
    """Recorded runs of programs (JSON Lines) with output cut at ``most_bytes`` together, standard output first, whether it was, and the failure's signature (type,
    message, file; null of a clean run)."""
    rows = json_lines(spark, path, RUNS)
    out, err = (F.coalesce(F.encode(c, "utf-8"), F.lit(b"")) for c in ("stdout", "stderr"))
    room = F.greatest(F.lit(most_bytes) - F.octet_length(out), F.lit(0))
    parsed = code.traceback(F.coalesce("stderr", F.lit("")), F.col("path"))
    known = F.when(parsed["type"].isNotNull(), F.struct(parsed["type"].alias("type"), parsed["message"].alias("message"), parsed["file"].alias("file")))
    late = F.coalesce("timed_out", F.lit(False))
    failed = late | (F.coalesce("exit_code", F.lit(0)) != 0)
    return rows.withColumns({
        "error_signature": F.when(failed, rules.signature(late, F.coalesce("exit_code", F.lit(0)), known, F.lit(limit))), "output_truncated": F.octet_length(out) + F.octet_length(err) > most_bytes,
        "stdout": F.decode(F.substring(out, 1, most_bytes), "utf-8"), "stderr": F.decode(F.call_function("substring", err, F.lit(1), room.cast("int")), "utf-8"),
    })


LINT = "array<struct<code:string,name:string,message:string,severity:string,location:struct<row:bigint,column:bigint>,end_location:struct<row:bigint,column:bigint>,fix:string>>"


def findings(raw: Column) -> Column:
    """Array of findings of a lint tool's JSON output: defaults filled in, positions clamped; one warning of output that is no JSON; none of empty output or of JSON that is no list."""
    t = T.strip(F.coalesce(raw, F.lit("")))
    parsed = F.from_json(t, LINT)
    one = F.lit(1).cast("long")
    is_json = F.call_function("try_parse_json", t).isNotNull()

    def finding(i: Column) -> Column:
        row = F.greatest(one, F.coalesce(i["location"]["row"], one))
        col = F.greatest(one, F.coalesce(i["location"]["column"], one))
        end = F.greatest(row, F.coalesce(i["end_location"]["row"], row))
        end_col = F.coalesce(i["end_location"]["column"], col)
        level = F.lower(F.coalesce(i["severity"], F.lit("")))
        return F.struct(
            F.coalesce(i["code"], i["name"], F.lit("RUFF")).alias("code"), F.coalesce(i["message"], F.lit("Lint finding")).alias("message"),
            F.when(level.isin("error", "info"), level).otherwise("warning").alias("severity"), row.alias("start_line"), col.alias("start_col"), end.alias("end_line"),
            F.when(end == row, F.greatest(col, end_col)).otherwise(end_col).alias("end_col"), i["fix"].isNotNull().alias("fix_available"),
        )

    kind = "array<struct<code:string,message:string,severity:string,start_line:bigint,start_col:bigint,end_line:bigint,end_col:bigint,fix_available:boolean>>"
    broken = F.array(F.struct(F.lit("MalformedOutput").alias("code"), F.lit("output is no JSON").alias("message"), F.lit("warning").alias("severity"), one.alias("start_line"), one.alias("start_col"), one.alias("end_line"), one.alias("end_col"), F.lit(False).alias("fix_available")))
    listed = F.when(t.startswith("["), F.transform(F.filter(parsed, lambda i: i.isNotNull()), finding))
    empty = F.array().cast(kind)
    return F.when(t == "", empty).when(~is_json, broken.cast(kind)).otherwise(F.coalesce(listed.cast(kind), empty))


def input_errors(raw: Column) -> Column:
    """Array of what keeps a JSON text from being a profile input: size, syntax, shape, depth, unknown fields, keyword names."""
    keys = F.json_object_keys(raw)
    names = F.json_object_keys(F.get_json_object(raw, "$.kwargs"))
    is_object = T.strip(raw).startswith("{") & F.call_function("try_parse_json", raw).isNotNull()
    return F.array_compact(F.array(
        F.when(F.octet_length(raw) > MOST_INPUT, "too large"), F.when(~F.coalesce(is_object, F.lit(False)), "not an object"), F.when(T.json_depth(raw) > DEEPEST_INPUT, "too deep"),
        F.when(is_object & (F.size(F.array_except(keys, F.array(F.lit("args"), F.lit("kwargs"), F.lit("stdin")))) > 0), "unknown field"),
        F.when(F.coalesce(~T.is_identifier_keys(names), F.lit(False)), "keyword name"),
    ))
