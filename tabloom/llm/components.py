"""Connected components of an edge table by alternating large-star and small-star rounds.

Nodes are binary keys.  Nothing is collected: each round is a map-side combined
minimum per node and a join back, written to the shared folder, so a hub with
most of all edges costs one partial minimum per task and a splittable join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import written

# edges of one file
PER_FILE = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: link each node's larger (or smaller) neighbours to its minimum neighbour."""
    if large:
        near = edges.union(edges.select("v", "u")).toDF("node", "other")
    else:
        near = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other"))
    low = near.groupBy("node").agg(F.min("other").alias("low"))
    if large:
        low = low.select("node", F.least("node", "low").alias("low"))
        out = near.join(low, "node").where(F.col("other") > F.col("node")).select(
            F.col("other").alias("u"), F.col("low").alias("v"))
    else:
        out = near.join(low, "node").select(F.col("other").alias("u"), F.col("low").alias("v")).union(
            low.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component; ``edges`` has columns u, v.

    Self loops, repeated and null edges do no harm; no edges give no rows.
    Ends when every edge points at the minimum of its component: then the
    edge list is a set of stars and neither step changes it.
    """
    edges = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges",
                    edges.count(), PER_FILE)
    mark = _fingerprint(edges)
    while mark[0]:
        # a round has no more edges than the one before and its nodes, at most twice the edges
        edges = written(_star(_star(edges, large=True), large=False), "edges", 3 * mark[0], PER_FILE)
        last, mark = mark, _fingerprint(edges)
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and an order-free sum over the edges: two numbers reach the driver."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.sum(F.pmod(h, F.lit(1000003)))).first()
    return tuple(row)
