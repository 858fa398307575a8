"""Token counts of flat token files.

A token file holds the ids of document after document as little-endian integers of 16 bits (or ``width`` bytes), each closed by the
end-of-document id, without an index. Blocks of a file are searched for that id with vectorised comparison, each by whichever
task gets it; a prefix scan over the blocks' sums, in two levels, then stitches documents that cross block borders.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, new_path, remove_path
from .warc import open_fs

END = 50256  #: end-of-document id of the default vocabulary
WIDTH = 2  #: bytes of an id
SPAN = 1024  #: blocks that are scanned as one run by the lower level


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END, target_bytes: int = 256 << 20, width: int = WIDTH) -> DataFrame:
    """Encode the texts of ``docs`` into token files below ``folder``: returns (path, ordinal, doc_id), the order of documents in each file.

    A task writes files of about ``target_bytes``. Each goes under a name of the attempt and is complete before its rows are returned, so
    files of lost attempts are never listed. Null and empty texts are documents of no tokens. A special token's string
    in a text is ordinary text, so ``end`` stands at ends alone. A vocabulary, or an ``end``, with ids beyond ``width`` bytes is refused.
    """
    path = path or bpe.default_path()
    most = max(end, bpe.greatest_id(path))
    if width not in (2, 4) or most >= 1 << 8 * width:
        raise ValueError(f"ids up to {most} don't fit {width} bytes (2 or 4)")

    def run(batches):
        from pyspark import TaskContext

        context, coder = TaskContext.get(), bpe.load(path)
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        stop = int(end).to_bytes(width, "little")
        part, out, size, name, ids = 0, None, 0, "", []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, kind)], names=["path", "ordinal", "doc_id"])

        kind = None
        for batch in batches:
            kind = batch["doc_id"].type
            texts = coder.encode_batch([t or "" for t in batch["text"].to_pylist()], special=False)
            for doc_id, coded in zip(batch["doc_id"].to_pylist(), texts):
                if out is None:
                    name = f"tokens-{context.partitionId():05d}-{part:04d}-{context.taskAttemptId()}-{os.getpid()}.bin"
                    out, size, part = fs.open_output_stream(f"{base}/{name}", compression=None), 0, part + 1
                data = np.frombuffer(coded, "<u4").astype(f"<u{width}").tobytes() + stop
                out.write(data)
                size += len(data)
                ids.append(doc_id)
                if size >= target_bytes:
                    out.close()
                    yield rows()
                    out, ids = None, []
        if out:
            out.close()
            yield rows()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"path string, ordinal long, doc_id {kind}"), "token-order")


def scan_blocks(files: DataFrame, end: int = END, block_bytes: int = 1 << 20, width: int = WIDTH) -> DataFrame:
    """(path, block, n, ends) of each block of the files in column ``path``: its ids and the places of ``end`` among them.

    A block is read by byte range, whoever reads the others. Blocks begin at multiples of ``block_bytes``; bytes after a file's last whole id are no id.
    """
    block_bytes -= block_bytes % width

    def sizes(batches):
        for batch in batches:
            paths = batch["path"].to_pylist()
            bytes_ = [fs.get_file_info(p).size for fs, p in map(open_fs, paths)]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(bytes_, pa.int64())], names=["path", "n_bytes"])

    def run(batches):
        for batch in batches:
            found = []
            for uri, block in zip(batch["path"].to_pylist(), batch["block"].to_pylist()):
                fs, p = open_fs(uri)
                with fs.open_input_file(p) as f:
                    f.seek(block * block_bytes)
                    data = f.read(block_bytes)
                ids = np.frombuffer(data[: len(data) - len(data) % width], f"<u{width}")
                found.append((len(ids), np.flatnonzero(ids == end)))
            yield pa.RecordBatch.from_arrays(
                [batch["path"], batch["block"], pa.array([n for n, _ in found], pa.int64()), pa.array([e for _, e in found], pa.list_(pa.int64()))],
                names=["path", "block", "n", "ends"],
            )

    sized = materialize(files.select("path").distinct().mapInArrow(sizes, "path string, n_bytes long"), "token-files")
    blocks = sized.select("path", F.explode(F.expr(f"sequence(0L, (greatest(n_bytes, 1L) - 1L) div {block_bytes}L)")).alias("block"))
    n = int(sized.agg(F.sum(F.expr(f"1 + n_bytes div {block_bytes}"))).head()[0] or 1)
    tasks = min(n, max(files.sparkSession.sparkContext.defaultParallelism * 4, n // 64))
    return blocks.repartition(tasks).mapInArrow(run, "path string, block long, n long, ends array<bigint>")


def stitch(blocks: DataFrame, span: int = SPAN) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed) of each document of the scanned files.

    Running sums of ids and of ends, and the greatest place of an end so far, carry over from block to block of a file: within runs of
    ``span`` blocks first, then over the runs' sums, so that no task holds all blocks of a file. Ids after a file's last end are an unclosed document.
    """
    n_ends, last = F.size("ends").cast("long"), F.when(F.size("ends") > 0, F.element_at("ends", -1))
    rows = blocks.withColumns({"run": F.floor(F.col("block") / span).cast("long"), "n_ends": n_ends})

    def scanned(df: DataFrame, by: list[str], order: str, final: str) -> DataFrame:
        """Adds at, ordinal and first: ids, ends and the place after the last end before a row; ``final``: whether no row comes after it."""
        own = Window.partitionBy(*by).orderBy(order)
        before = own.rowsBetween(Window.unboundedPreceding, -1)
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        placed = df.withColumn("at", zero(F.sum("n").over(before)))
        placed = placed.withColumns({"ordinal": zero(F.sum("n_ends").over(before)), final: F.lead(order).over(own).isNull(), "__end": F.col("at") + F.col("last")})
        return placed.withColumn("first", zero(F.max("__end").over(before) + 1)).drop("__end")

    low = scanned(rows.withColumn("last", last), ["path", "run"], "block", "last_of_run")
    sums = low.groupBy("path", "run").agg(F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"), F.max(F.col("at") + F.col("last")).alias("last"))
    high = scanned(sums, ["path"], "run", "last_run").select("path", "run", "last_run", F.col("at").alias("at0"), F.col("ordinal").alias("ordinal0"), F.col("first").alias("first0"))
    placed = low.join(high, ["path", "run"])
    placed = placed.withColumns({
        "at": F.col("at") + F.col("at0"), "ordinal": F.col("ordinal") + F.col("ordinal0"), "final": F.col("last_of_run") & F.col("last_run"),
        "first": F.when(F.col("first") > 0, F.col("at0") + F.col("first")).otherwise(F.col("first0")),
    })
    placed = placed.withColumn("last", F.col("at") + F.col("last"))
    closed = placed.select("path", "ordinal", "first", "at", "ends", F.posexplode("ends").alias("k", "end")).select(
        "path", (F.col("ordinal") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("first")).otherwise(F.col("at") + F.expr("get(ends, k - 1)") + 1).alias("start"),
        (F.col("at") + F.col("end")).alias("stop"), F.lit(True).alias("closed"),
    )
    rest = placed.filter("final").select(
        "path", (F.col("ordinal") + F.size("ends")).alias("ordinal"), F.coalesce(F.col("last") + 1, F.col("first")).alias("start"),
        (F.col("at") + F.col("n")).alias("stop"), F.lit(False).alias("closed"),
    ).filter("stop > start")
    return closed.union(rest).select("path", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def count_tokens(files: DataFrame, span: int = SPAN, **options) -> DataFrame:
    """Documents of flat token files (column ``path``) with their tokens: see ``scan_blocks`` and ``stitch``. Files without ids have none."""
    return stitch(scan_blocks(files, **options), span)


def document_counts(docs: DataFrame, path: str | None = None, span: int = SPAN, width: int = WIDTH, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ordinal (its place in its file).

    Texts are encoded into token files in the shared folder; the counts come from scanning those. Null and empty texts count 0.
    Repeated rows each give a row; only doc_id and text are read. An empty table gives no rows.
    """
    folder = new_path(docs.sparkSession, "tokens")
    order = write_token_files(docs, folder, path, width=width)
    blocks = materialize(scan_blocks(order, width=width, **options), "token-blocks")
    remove_path(docs.sparkSession, folder)
    return stitch(blocks, span).join(order, ["path", "ordinal"]).select("doc_id", "n_tokens", "ordinal")


def token_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Column ``path`` for ``count_tokens``, of files that others wrote."""
    return spark.createDataFrame([(p,) for p in paths], "path string")
