"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files are removed when a statement is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder is made if driver and executors are one process; on a
    cluster a folder of one machine won't do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_root()
    return root.rstrip("/")


@lru_cache(1)
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="barloom-checkpoints-")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that outlives any executor; columnar and
    compressed, so it is smaller than an RDD checkpoint.  Once the table is
    complete nothing reads the shuffles that led to it, and their files go.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/barloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


_REMEMBERED: dict[tuple, DataFrame] = {}


def remembered(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of an application start from, written by :func:`durable` the first time.

    It is built anew when one of its ``sources`` (paths) changes or its files are gone.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def stamp(path: str) -> tuple:
        at = jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(conf).getFileStatus(at)
        return path, found.getModificationTime(), found.getLen()

    key = (spark.sparkContext.applicationId, checkpoint_root(spark), name, *map(stamp, sources))
    found = _REMEMBERED.get(key)
    if found is not None:
        at = jvm.org.apache.hadoop.fs.Path(found.inputFiles()[0])
        if at.getFileSystem(conf).exists(at):
            return found
    _REMEMBERED[key] = durable(build(), name)
    return _REMEMBERED[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`durable`."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    jvm = spark._jvm
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/barloom/" in path.toString() and path.toString().split("/barloom/")[0].endswith(root.split(":", 1)[-1].lstrip("/")):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            break


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_barloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="barloom-"), "barloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("barloom", os.path.relpath(path, here)))
    context.addPyFile(archive)
    context._barloom_shipped = True
