"""Session settings shared by tests and the bench, and the shared work folder."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("litscore")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return with_scratch_dir(spark)


def with_scratch_dir(spark: SparkSession) -> SparkSession:
    """Give a session on one machine a work folder, if it names none.

    For tests, the bench and other callers that start such a session; on a cluster the
    setting has to name a folder all executors share.
    """
    if spark.sparkContext.master.startswith("local") and not _named_dir(spark):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="litscore-"))
    return spark


def _named_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def send_by_value(module: str) -> None:
    """Have the functions of a module travel with the tasks that call them.

    Workers then need not have this package installed.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``."""
    folder, context = _named_dir(spark), spark.sparkContext
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_scopes = threading.local()


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made inside when the block ends.

    Whatever is to last has to be written elsewhere before. Scopes nest; each thread has
    its own.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; inside a scope it is deleted with it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    stack = _scopes.__dict__.get("stack")
    if stack:
        stack[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, so a plan that uses
    ``df`` more than once neither recomputes it nor depends on its cached blocks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table of fewer partitions than cores over all of them.

    For costly text work on a table that is one small file. A large table has more
    partitions than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
