"""Makes the package importable where Python tasks run, and names the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_kept: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once an application, unless their Python finds it already by PYTHONPATH or the working folder."""
    context = spark.sparkContext
    home = str(ROOT.parent)
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.path.realpath(os.getcwd())}
    if os.path.realpath(home) in known or os.path.exists(os.path.join(os.getcwd(), ROOT.name)) or context.applicationId in _shipped:
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="tracelens-"), f"{ROOT.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for f in ROOT.rglob("*.py"):
            out.write(f, f.relative_to(ROOT.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a fresh temporary folder and any other master the warehouse, never a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracelens.shared.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="tracelens-")
        spark.conf.set("tracelens.shared.dir", base)
    return (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables. It is removed when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/tracelens/{spark.sparkContext.applicationId}"
    if folder not in _kept:
        fs, p = hadoop_fs(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _kept.add(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the application's folder and read again: cuts lineage, survives lost executors."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
