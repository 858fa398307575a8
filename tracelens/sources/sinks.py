"""Sinks: JSON Lines by split, manifests, envelopes, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..session import hadoop_fs


#: Name of the file that describes a committed output, beside its data.
MANIFEST = "_manifest.json"


def commit(rows: DataFrame, folder: str, name: str, counts: dict[str, Column] | None = None, split: str | None = None, format: str = "json", facts: dict | None = None) -> dict:
    """Write ``rows`` (a folder for each value of ``split``) with their manifest as one output: all of it is there, or nothing.

    The rows go to a folder beside, where failed and repeated tasks leave nothing that counts; then one rename puts it in place. The manifest's
    ``counts`` (aggregates, ``total_samples`` always) are observed while the rows are written, so nothing is read twice; ``facts`` are told as they are. An output that is there already
    stays until the new one is complete; a failure on the way leaves it as it was. Returns the manifest.
    """
    spark, staged = rows.sparkSession, f"{folder}.staged-{uuid.uuid4().hex}"
    seen = Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("total_samples"), *[c.alias(k) for k, c in (counts or {}).items()])
    fs, path = hadoop_fs(spark, staged)
    final, old = hadoop_fs(spark, folder)[1], hadoop_fs(spark, f"{staged}.old")[1]
    try:
        writer = observed.write.format(format).option("ignoreNullFields", False)
        (writer.partitionBy(split) if split else writer).save(staged)
        made = {"dataset_name": name, "version": "1.0", **(facts or {}), **seen.get}
        stream = fs.create(hadoop_fs(spark, f"{staged}/{MANIFEST}")[1])
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        if replaced := fs.exists(final):
            fs.rename(final, old)
        if not fs.rename(path, final):
            if replaced:
                fs.rename(old, final)
            raise OSError(f"{folder} could not be put in place")
        fs.delete(old, True)
    finally:
        fs.delete(path, True)
    return made


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of a committed output; an error if there is none."""
    fs, path = hadoop_fs(spark, f"{folder}/{MANIFEST}")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def per_value(column: str, values: list[str]) -> dict[str, Column]:
    """Counts for ``commit``: how many rows have each of the values."""
    return {v: F.count_if(F.col(column) == v) for v in values}


def write_splits(pairs: DataFrame, folder: str, split: str = "split", names: Sequence[str] = ("train", "val", "test")) -> dict:
    """One folder of JSON Lines for each split, and how many rows each has; null fields are written. See ``commit``."""
    return commit(pairs, folder, "splits", per_value(split, list(names)), split)


def manifest(pairs: DataFrame, name: str, split: str, task: str, category: str, tokens: list[str]) -> DataFrame:
    """One row, column ``json``: split shares, task and category frequencies, token statistics of a dataset. The tables that are joined have a row each."""
    def as_map(rows: DataFrame, key: str, value: Column, out: str) -> DataFrame:
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value.alias("v"))))).alias(out))

    share = F.struct(F.col("n").alias("count"), F.col("pct").alias("percentage"))
    parts = [
        as_map(stats.shares(pairs, split), split, share, "splits"), as_map(stats.shares(pairs, task), task, share, "task_distribution"),
        as_map(stats.shares(pairs, category), category, F.col("n"), "category_distribution"),
        stats.grouped(pairs, [], [F.count(F.lit(1)).alias("total_samples"), *[f(c).alias(f"{n}_{c}") for c in tokens for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]], {f"median_{c}": F.col(c) for c in tokens})
        .select("total_samples", F.struct(*[F.struct(
            F.coalesce(f"min_{c}", F.lit(0)).alias("min"), F.coalesce(f"max_{c}", F.lit(0)).alias("max"), F.coalesce(F.round(f"mean_{c}", 2), F.lit(0.0)).alias("mean"),
            F.coalesce(F.round(f"median_{c}", 2), F.lit(0.0)).alias("median")).alias(c) for c in tokens]).alias("token_statistics")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # single rows
    fields = [F.lit(name).alias("dataset_name"), "total_samples", "splits", "task_distribution", "category_distribution", "token_statistics"]
    return out.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def envelope(command: str, success: Column, target: Column, data: Column, errors: Column, limitations: Column) -> Column:
    """JSON of an envelope; null fields stay."""
    fields = F.struct(F.lit("1.0").alias("schema_version"), F.lit(command).alias("command"), success.alias("success"), target.alias("target_path"), data.alias("data"), errors.alias("errors"), limitations.alias("limitations"), F.create_map().cast("map<string,string>").alias("metadata"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row, column ``markdown``: a table of few rows, such as suite summaries."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = F.array_join(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))["l"], "\n")
    return rows.agg(F.concat(F.lit(head), body).alias("markdown"))
