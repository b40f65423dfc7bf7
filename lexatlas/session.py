"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark removes the shuffle files of a query as soon as it has ended, not when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidying = {}


class Guard:
    """A lock that travels with the functions of this package; whoever gets one has a lock of its own."""

    def __init__(self) -> None:
        self.lock = threading.Lock()

    def __reduce__(self) -> tuple:
        return Guard, ()


_guard = Guard()


def build_session(app: str = "lexatlas", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators expect. On a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` has named.

    Where neither is set, a session whose driver and executors are one process gets a temporary folder;
    every other master must name a folder that all executors can reach.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexatlas-"))
        return context.getCheckpointDir().rstrip("/")
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Queries that are run in here leave no shuffle files; the session's own setting comes back with the last of several."""
    key = id(spark._jsparkSession)
    with _guard.lock:
        users, before = _tidying.get(key) or (0, spark.conf.get(TIDY, None))
        _tidying[key] = (users + 1, before)
        spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        with _guard.lock:
            users, before = _tidying.pop(key)
            if users > 1:
                _tidying[key] = (users - 1, before)
            elif before is None:
                spark.conf.unset(TIDY)
            else:
                spark.conf.set(TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    One computation, survives the loss of executors, and the reader gets exact sizes, which a
    cached or locally checkpointed frame would not give. What was shuffled for it is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexatlas-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._lx_path = path
    return made


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the package has written to the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(*tables: DataFrame | None) -> None:
    """Delete what :func:`cut` has written for these very frames, which nothing may read any more; other frames and None are left alone."""
    for table in tables:
        path = getattr(table, "_lx_path", None) if isinstance(table, DataFrame) else None
        if path is not None:
            remove(table.sparkSession, path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
