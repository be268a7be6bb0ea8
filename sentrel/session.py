"""Session and table helpers shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sentrel")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test layout; columns are pruned by the plan that reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where frames that cut_lineage() wrote lie, for release().
_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the cluster names in ``spark.checkpoint.dir``.

    A local master has one machine, so there a temporary folder stands in where none is named. Anywhere else that
    would scatter the files over the executors' own disks, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sentrel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files as soon as they are over; for plans that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written folder that nothing needs any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def release(*frames: DataFrame) -> None:
    """Delete what cut_lineage() wrote for frames whose readers have all run."""
    for df in frames:
        path = _WRITTEN.pop(df, None)
        if path:
            discard(df.sparkSession, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, so that they need no path to it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="sentrel-"), "sentrel_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        file = os.path.join(folder, n)
                        z.write(file, os.path.relpath(file, os.path.dirname(root)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
