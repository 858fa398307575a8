"""Shared plumbing of the corpus operators: tables, shared storage, Arrow maps, graph components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_fs, own_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once results are written."""
    remove_path(spark, own_folder(spark))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tracelens_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    remove_path(df.sparkSession, df._tracelens_path)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def text_map(
    df: DataFrame,
    columns: Iterable[str],
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
) -> DataFrame:
    """Map record batches of only ``columns``. ``make`` runs once per task and gives the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield from f(batch)

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``df`` that the function from ``make`` keeps, all columns as they are.

    Rows pass through Python in batches and are judged where they lie. (A filter on a Python column holds the rows in the
    JVM meanwhile, which takes more memory.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield part.filter(pa.array(f(part), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def utf8(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, some rows at a time; null gives b''."""
    for at in range(0, len(column), rows):
        for x in column.slice(at, rows).cast(pa.binary()).to_pylist():
            yield x or b""


# --- connected components -------------------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: each node hands its larger neighbours to the smallest of its
    neighbourhood. Small: each node hands its smaller neighbours, and itself, to the smallest.

    The smallest neighbour comes from a map-side combined aggregate and a join. The aggregate's key is joined as an
    expression (u ^ 0), so that both sides of the join are exchanges of its own: only such ones can AQE split at a hub.
    """
    if large:
        pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(low.select(F.expr("u ^ 0L").alias("__u"), "m"), F.col("u") == F.col("__u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links between long nodes -> (node, label): label is the smallest node reachable.

    Alternating large-star and small-star until the links no longer change; each round is
    written to the shared folder, so lineage stays short and a lost executor costs one round.
    Nodes without a link are not in the result; null ends and self links are ignored.
    """
    current = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000000007)).head()
        if state == seen or state[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = state
        big = materialize(_star(current, True), "links")
        nxt = materialize(_star(big, False), "links")
        discard(current), discard(big)
        current = nxt
    raise RuntimeError("components did not settle")
