"""Shared plumbing of the operators: tables, scratch folders, bounded broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only in local mode and where unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile
        path = tempfile.mkdtemp(prefix="tabloom-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark removes the shuffle files of what runs inside as soon as it has ended.

    For writes whose result is read from its files: a task that is run again still finds or remakes
    them, and nothing needs them afterwards.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """What is written inside goes to Python in batches of ``BATCH_BYTES``: a batch counts several times in
    an executor's memory (Arrow buffers on both sides, copies in the worker)."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


_scratch: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession):
    """Tables written inside are removed at the end; what is still needed is written with ``keep=True``.

    Only for steps whose results no longer read them: a task that is run again later reads the kept table.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, rows: int | None = None, per_file: int = 20_000, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with files that outlive any executor.  ``rows``: a known bound of its size; a
    small table is then written in few files (``per_file`` rows each) instead of one per partition.
    ``keep``: it outlives the :func:`scratch_tables` around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _scratch and not keep:
        _scratch[-1].append(path)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_worker(key: str, build: Callable):
    """``build()`` once per Python worker process: workers outlive tasks, pickled functions do not."""
    import sys
    import types
    held = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL, if any."""
    def deco(fn):
        if name in LLM_QUERIES:
            raise ValueError(f"duplicate query key {name}")
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return deco
