"""Lineage cuts that survive lost executors, and shipping of this package to them."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether Spark deletes the shuffle files of a query when it ends, not only when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps neither recompute it nor depend on executors' disks."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/helixlake/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # what is written needs its shuffles no more, and the next step has its own
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    _at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for made in _scopes:
        made.append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """What is staged inside is deleted at the end, but for what the caller takes out of the list that this gives: for work
    whose result is itself staged, and then reads nothing else."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for df in made:
            unstage(df)


def _at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends, if nothing did so before: results read it until then."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(df: DataFrame | None) -> None:
    """Delete the files of a staged table that no later step reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        delete(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_helixlake_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(top)
    to = os.path.join(tempfile.mkdtemp(prefix="helixlake-src-"), "helixlake_src.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(to)
    sc._helixlake_shipped = True
    if spark.conf.get(_BATCH) == "10000":  # unless the user set it: smaller batches bound what Python tasks hold of long texts
        spark.conf.set(_BATCH, "2000")
