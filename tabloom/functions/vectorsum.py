"""Sums of one numeric vector over all rows: each task adds up its rows in NumPy, Spark or the driver the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# bytes of all tasks' vectors that the driver adds up itself
DIRECT_BYTES = 64 << 20


def vector_sum(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int,
               tasks: int | None = None) -> np.ndarray:
    """Sum over the tasks of ``add(batches)``, a float64 vector of ``width``.

    Where ``tasks`` vectors are at most ``DIRECT_BYTES`` together they are fetched and added in
    task order (one stage, the same result at every run); beyond, Spark adds them per place and
    only one vector reaches the driver.
    """
    if tasks is not None and 8 * width * tasks <= DIRECT_BYTES:
        def whole(batches):
            from pyspark import TaskContext
            total = np.ascontiguousarray(add(batches), dtype="<f8")
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())],
                                  names=["task", "v"])

        got = sorted(((r["task"], r["v"]) for r in rows.mapInArrow(whole, "task long, v binary").collect()), key=lambda r: r[0])
        return sum((np.frombuffer(v, "<f8") for _, v in got), np.zeros(width))

    def places(batches):
        total = add(batches)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["i", "v"])

    got = rows.mapInArrow(places, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def block_sum(blocks: RDD, add: Callable[[Iterator], np.ndarray], width: int) -> np.ndarray:
    """:func:`vector_sum` over an RDD of blocks."""
    def whole(task, rows):
        yield task, np.ascontiguousarray(add(rows), dtype="<f8").tobytes()

    sums = blocks.mapPartitionsWithIndex(whole)
    if 8 * width * blocks.getNumPartitions() > DIRECT_BYTES:
        return np.frombuffer(sums.values().treeReduce(lambda a, b: (np.frombuffer(a, "<f8") + np.frombuffer(b, "<f8")).tobytes()), "<f8")
    return sum((np.frombuffer(v, "<f8") for _, v in sorted(sums.collect())), np.zeros(width))


def task_count(df: DataFrame) -> int:
    """Partitions of a materialised table."""
    return df.rdd.getNumPartitions()
