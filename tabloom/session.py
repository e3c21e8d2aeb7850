"""Session construction and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every session of the library relies on.  On a cluster the
# operator sets the rest (executor memory, shuffle partitions sized to the
# data, spark.checkpoint.dir on shared storage).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tabloom", extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is only read;
    without it the call fails.  In local mode (tests) a fresh folder under the
    system temp dir is created and registered once where it is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tabloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-path of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


TASK_ROWS = 4_000_000   # rows of a task in a table dealt by `spread`, where their number is known


def spread(df, rows: int | None = None):
    """The rows dealt evenly over as many tasks as the cluster runs at once.

    For tables that many passes read: a file of few row groups otherwise keeps most cores idle in each of them,
    and a table of many small parts spends each pass on starting tasks.  With ``rows``, a task gets at most
    ``TASK_ROWS`` of them: larger tables take several tasks a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-(rows or 0) // (cores * TASK_ROWS))))


_HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession):
    """Plans run inside keep generated methods within the 8000 bytes that the JVM compiles.

    For wide rows of expressions: one method of them all would be interpreted, row by row.
    """
    before = spark.conf.get(_HUGE_METHOD, None)
    spark.conf.set(_HUGE_METHOD, "8000")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_HUGE_METHOD)
        else:
            spark.conf.set(_HUGE_METHOD, before)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for paths that Python must open itself."""
    return path[5:] if path.startswith("file:") else path


__all__ = ["get_spark", "checkpoint_dir", "scratch_path", "cut_lineage", "spread", "compiled_methods", "local_path", "BASE_CONF"]
