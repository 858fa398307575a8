"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards (Parquet files). Shards of similar size, those of one tier, are merged into files of
the target size once enough of them have gathered. A version of the table is a manifest: a short list of segments, immutable files that
hold a line for each shard. A change writes the segments that are new and the next version's list under a temporary name, and renames that
into place, which fails if another writer was first. So an append writes lines for its own shards alone.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop_fs, new_path, read_table


#: Greatest number of manifest lines that are broadcast to the rows' tasks.
BROADCAST_SHARDS = 100_000


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def tier(n_bytes: int, least: int, fanout: int) -> int:
    """Tier of a shard: 0 up to ``least`` bytes, then one more for each factor ``fanout``."""
    return 0 if n_bytes <= least else 1 + int(math.log(n_bytes / least, fanout))


def pack(shards: list[dict], target: int) -> list[list[dict]]:
    """Runs of shards, in order of arrival, of at most ``target`` bytes together; runs of one are left out."""
    runs: list[list[dict]] = [[]]
    for s in sorted(shards, key=lambda s: (s["seq"], s["path"])):
        if runs[-1] and sum(x["bytes"] for x in runs[-1]) + s["bytes"] > target:
            runs.append([])
        runs[-1].append(s)
    return [r for r in runs if len(r) > 1]


class ShardStore:
    """A table of shards below ``root``. The driver holds the manifest alone: a line for each file, never rows."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, least_bytes: int = 4 << 20, fanout: int = 4, fan_in: int = 4, runs_per_job: int = 256):
        self.spark, self.root = spark, root.rstrip("/")
        self._read: dict[str, list[dict]] = {}
        self.target, self.least, self.fanout, self.fan_in, self.runs_per_job = target_bytes, least_bytes, fanout, fan_in, runs_per_job

    # --- manifest ---------------------------------------------------------------------------------

    def _text(self, path: str) -> str:
        fs, p = hadoop_fs(self.spark, path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str):
        fs, p = hadoop_fs(self.spark, path)
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return fs, p

    def versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.root}/_manifest")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:-4]) for n in names if n.startswith("v") and n.endswith(".txt"))

    def segments(self, version: int | None = None) -> tuple[int, list[str]]:
        """(version, its segments); version 0 is the empty table."""
        version = (self.versions() or [0])[-1] if version is None else version
        return version, self._text(f"{self.root}/_manifest/v{version:010d}.txt").split() if version else []

    def shards_of(self, segment: str) -> list[dict]:
        """The lines of a segment, which never changes: each is read once."""
        if segment not in self._read:
            self._read[segment] = [json.loads(x) for x in self._text(f"{self.root}/_manifest/{segment}").splitlines()]
        return self._read[segment]

    def manifest(self, version: int | None = None) -> tuple[int, list[dict]]:
        """(version, live shards)."""
        version, segments = self.segments(version)
        return version, [s for name in segments for s in self.shards_of(name)]

    def segment(self, shards: list[dict]) -> list[str]:
        """Write a segment of these shards: its name, in a list; none for no shards."""
        if not shards:
            return []
        name = f"segment-{uuid.uuid4().hex}.jsonl"
        self._put(f"{self.root}/_manifest/{name}", "".join(json.dumps(s, sort_keys=True) + "\n" for s in shards))
        return [name]

    def commit(self, base: int, segments: list[str]) -> int:
        """Make these segments version base + 1, atomically; Conflict if that version exists."""
        fs, tmp = self._put(f"{self.root}/_manifest/_tmp-{uuid.uuid4().hex}", "".join(f"{s}\n" for s in segments))
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(tmp.toUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, hadoop.Path(f"{self.root}/_manifest/v{base + 1:010d}.txt"), sc._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base + 1}") from e
            raise
        return base + 1

    # --- shards -----------------------------------------------------------------------------------

    def _described(self, folder: str, seq: int) -> list[dict]:
        """Entries of the files of a folder: bytes from the file system, rows from the footers' counts."""
        fs, p = hadoop_fs(self.spark, folder)
        if not fs.exists(p):
            return []
        sizes = {x.getPath().getName(): x.getLen() for x in fs.listStatus(p) if x.getPath().getName().startswith("part-")}
        if not sizes:
            return []
        rows = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).count().collect()
        counts = {r["name"]: r["count"] for r in rows}
        return [{"path": f"{folder}/{n}", "bytes": b, "rows": counts.get(n, 0), "seq": seq, "of": len(sizes)} for n, b in sorted(sizes.items())]

    def append(self, rows: DataFrame) -> int:
        """Write ``rows`` as an arrival of new shards, one for each task that has rows, and commit them. An arrival without rows is a
        version without new shards; null and repeated rows are kept as they are."""
        folder = f"{self.root}/data/arrival-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self._add(folder)

    def append_arrivals(self, rows: DataFrame, arrival: Column, n: int) -> int:
        """Write ``rows`` as n arrivals in one pass: ``arrival`` (0 to n - 1) tells each row's. They are committed one after the other."""
        folder = f"{self.root}/data/arrivals-{uuid.uuid4().hex}"
        rows.withColumn("__arrival", arrival).write.option("compression", "zstd").partitionBy("__arrival").parquet(folder)
        for k in range(n):
            self._add(f"{folder}/__arrival={k}")
        return (self.versions() or [0])[-1]

    def _add(self, folder: str, tries: int = 10) -> int:
        new: list[str] | None = None
        for _ in range(tries):
            base, segments = self.segments()
            if new is None:
                new = self.segment([s for s in self._described(folder, base + 1) if s["rows"]])
            try:
                return self.commit(base, segments + new)
            except Conflict:
                continue
        raise Conflict("append")

    def runs(self, live: list[dict]) -> list[list[dict]]:
        """What to merge next: of each tier that holds ``fan_in`` shards or more, the runs that fit the target."""
        tiers: dict[int, list[dict]] = {}
        for s in live:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(tier(s["bytes"], self.least, self.fanout), []).append(s)
        return [r for _, own in sorted(tiers.items()) if len(own) >= self.fan_in for r in pack(own, self.target)]

    def compact(self, max_rounds: int = 16) -> int:
        """Merge until no tier has a run left. Each run is read and written by one task, without a shuffle. An empty table stays as it is."""
        version, live = self.manifest()
        for _ in range(max_rounds):
            runs = self.runs(live)
            if not runs:
                break
            made, gone = [], set()
            for at in range(0, len(runs), self.runs_per_job):
                some = runs[at : at + self.runs_per_job]
                folder = f"{self.root}/data/merged-{uuid.uuid4().hex}"
                parts = [self.spark.read.parquet(*[s["path"] for s in r]).coalesce(1) for r in some]
                reduce(DataFrame.unionByName, parts).write.option("compression", "zstd").parquet(folder)
                made += self._described(folder, min(s["seq"] for r in some for s in r))
                gone |= {s["path"] for r in some for s in r}
            if sum(s["rows"] for s in made) != sum(s["rows"] for s in live if s["path"] in gone):
                raise RuntimeError("a merge changed the number of rows")
            version, live = self._swap(gone, made)
        return version

    def _swap(self, gone: set[str], made: list[dict], tries: int = 10) -> tuple[int, list[dict]]:
        """Commit merged shards in place of those they hold, over whatever was appended meanwhile. Segments without any of those stay."""
        for _ in range(tries):
            base, segments = self.segments()
            if not gone <= {s["path"] for name in segments for s in self.shards_of(name)}:
                raise Conflict("another compaction took these shards")
            touched = [name for name in segments if any(s["path"] in gone for s in self.shards_of(name))]
            rest = [s for name in touched for s in self.shards_of(name) if s["path"] not in gone]
            after = [name for name in segments if name not in touched] + self.segment(rest + made)
            try:
                return self.commit(base, after), [s for name in after for s in self.shards_of(name)]
            except Conflict:
                continue
        raise Conflict("compact")

    def vacuum(self, older_seconds: float = 7 * 86400) -> int:
        """Delete files that the newest version doesn't list and that are older than ``older_seconds``: an arrival that another writer is
        still writing, or has not committed yet, is younger. Older versions can't be read afterwards."""
        _, live = self.manifest()
        keep = {s["path"].removeprefix(f"{self.root}/data/") for s in live}
        fs, p = hadoop_fs(self.spark, f"{self.root}/data")
        if not fs.exists(p):
            return 0
        n, before = 0, (time.time() - older_seconds) * 1000
        top = fs.makeQualified(p).toString().rstrip("/") + "/"
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            path = f.getPath().toString().removeprefix(top)
            if path.rsplit("/", 1)[1].startswith("part-") and "/_" not in path.replace("/__arrival=", "/") and path not in keep and f.getModificationTime() <= before:
                n += fs.delete(f.getPath(), False)
        return n

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with their shard's name as ``_shard``; None for a table without shards.

        Of a folder all of whose files are live the folder is read, so that what Spark lists is a name for each merge job or arrival, not for each shard.
        """
        _, live = self.manifest(version)
        if not live:
            return None
        folders: dict[str, list[dict]] = {}
        for s in live:
            folders.setdefault(s["path"].rsplit("/", 1)[0], []).append(s)
        paths: list[str] = []
        for folder, own in folders.items():
            paths += [folder] if len(own) == own[0]["of"] else [s["path"] for s in own]
        return self.spark.read.schema(self.spark.read.parquet(live[0]["path"]).schema).parquet(*paths).withColumn("_shard", F.col("_metadata.file_name"))


#: Arrivals that the documents are appended in.
ARRIVALS = 4


def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, shard, shard_rows, text_sha256 (null text: of '').

    All rows and columns are appended in ARRIVALS arrivals, by a hash of the row's doc_id and text, compacted and read back through the
    manifest; repeated rows and nulls stay as they are. An empty table has no shards and gives no rows.
    """
    store = ShardStore(spark, new_path(spark, "shards"))
    docs = read_table(spark, sf_dir, "documents")
    store.append_arrivals(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(ARRIVALS)), ARRIVALS)
    store.compact()
    store.vacuum(0)  # nobody else writes here
    rows = store.read()
    if rows is None:
        return docs.limit(0).select("doc_id", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_rows"), F.lit("").alias("text_sha256"))
    live = store.manifest()[1]
    held = spark.createDataFrame([(s["path"].rsplit("/", 1)[1], s["rows"]) for s in live], "shard string, shard_rows long")
    if len(live) <= BROADCAST_SHARDS:
        held = F.broadcast(held)
    found = rows.select("doc_id", F.col("_shard").alias("shard"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return found.join(held, "shard").select("doc_id", "shard", "shard_rows", "text_sha256")
