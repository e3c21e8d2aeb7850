"""Exact quantiles with linear interpolation (pandas' default rule), in bounded memory.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group
in one buffer, which a hot group of a continuous column cannot afford.
Here rows are first reduced to (group, value, count), combined on the map
side, so a repeated value is one row however often it stands.  Each needed
order statistic is then found by bracket refinement over the distinct values:

1. distinct values, count, min and max per group (one pass);
2. while a bracket holds more than ``max_sort`` distinct values: an
   approximate quantile grid of them cuts it into cells, one weighted pass
   counts the cells, and the cell with the target rank is the new bracket;
3. the few values left in each bracket are ranked by a running count.

Every pass is an aggregate or a join with a table of brackets (groups x
ranks rows), so the work is distributed and the result is exact; columns
are unpivoted so one pass serves all of them.  A cell holds about a
thousandth of its bracket's values, so rounds are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.exprs import clean_num
from tabloom.functions.scan import with_place
from tabloom.session import cut_lineage

MAX_SORT = 1_000_000   # distinct values per (group, rank) that may be ranked in one task
GRID = 1_000           # grid points per refinement round
ACCURACY = 10_000      # percentile_approx accuracy (rank error <= 1/ACCURACY of the bracket)


def _long(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    args = []
    for c in cols:
        args += [F.lit(c), clean_num(c, df.schema[c].dataType)]
    return (df.select(*by, F.stack(F.lit(len(cols)), *args).alias("_c", "_v"))
            .where(F.col("_v").isNotNull()))


def order_statistics(counted: DataFrame, keys: list[str], ranks: DataFrame, max_sort: int = MAX_SORT) -> DataFrame:
    """Exact values at 0-based ranks.

    ``counted`` has ``keys``, a distinct double ``_v`` and its count ``_w``;
    ``ranks`` has ``keys``, ``_r`` (0-based rank), ``_d``, ``_lo`` and ``_hi``
    (distinct values, min, max of the group).  Returns ``keys, _r, _val``.
    """
    br = ranks.select(*keys, "_r", "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), F.col("_d"))
    probs = [i / GRID for i in range(1, GRID)]
    between = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    while br.where(F.col("_d") > max_sort).limit(1).count():
        big = br.where(F.col("_d") > max_sort)
        inside = counted.join(big.select(*keys, "_r", "_lo", "_hi", "_below"), keys).where(between)
        grid = inside.groupBy(*keys, "_r").agg(F.percentile_approx("_v", probs, ACCURACY).alias("_g"))
        cells = with_place(inside.join(grid, [*keys, "_r"]), "_cell", F.col("_g"), F.col("_v"), GRID - 1) \
            .groupBy(*keys, "_r", "_below", "_cell").agg(
                F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # at most GRID rows per (group, rank)
        w = Window.partitionBy(*keys, "_r").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = cells.withColumn("_upto", F.col("_below") + F.sum("_n").over(w)) \
            .where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_n")))
        # cut lineage so a round does not recompute the earlier ones (reliable checkpoint)
        br = cut_lineage(br.where(F.col("_d") <= max_sort).unionByName(found.select(
            *keys, "_r", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below"), "_d")))
    sel = counted.join(br, keys).where(between)
    w = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sel = sel.withColumn("_upto", F.col("_below") + F.sum("_w").over(w))
    return sel.where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_w"))) \
        .select(*keys, "_r", F.col("_v").alias("_val"))


def quantile_table(df: DataFrame, cols: list[str], probs: list[float], by: list[str] = (),
                   max_sort: int = MAX_SORT) -> DataFrame:
    """One row per group of ``by``; column ``c`` holds ``array<double>`` of the quantiles of ``c``.

    Nulls and NaN are skipped; a group without values gives null.
    """
    by = list(by)
    spark = df.sparkSession
    keys = by + ["_c"]
    long = _long(df, cols, by)
    counted = long.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    stats = counted.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_d"),
                                       F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    max_d = stats.agg(F.max("_d")).collect()[0][0] or 0
    if max_d <= max_sort:
        # every group is small enough for Spark's exact aggregate (buffer <= max_sort distinct values)
        plit = F.array(*[F.lit(float(p)) for p in probs])
        arr = counted.groupBy(*keys).agg(F.percentile(F.col("_v"), plit, F.col("_w")).alias("_a"))
        return _wide(spark, arr, cols, by)
    counted = cut_lineage(counted)   # every round reads it
    parr = F.array(*[F.struct(F.lit(i).alias("pi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    targets = stats.select(*keys, "_n", "_d", "_lo", "_hi", F.explode(parr).alias("t"))
    pos = F.col("t.p") * (F.col("_n") - 1)
    targets = targets.select(*keys, "_n", "_d", "_lo", "_hi", F.col("t.pi").alias("_pi"),
                             F.floor(pos).cast("bigint").alias("_r0"),
                             F.least(F.floor(pos).cast("bigint") + 1, F.col("_n") - 1).alias("_r1"),
                             (pos - F.floor(pos)).alias("_frac"))
    ranks = targets.select(*keys, "_d", "_lo", "_hi", F.explode(F.array("_r0", "_r1")).alias("_r")).distinct()
    vals = order_statistics(counted, keys, ranks, max_sort)
    v0 = vals.select(*keys, F.col("_r").alias("_r0"), F.col("_val").alias("_v0"))
    v1 = vals.select(*keys, F.col("_r").alias("_r1"), F.col("_val").alias("_v1"))
    q = targets.join(v0, [*keys, "_r0"]).join(v1, [*keys, "_r1"]) \
               .select(*keys, "_pi", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_frac")).alias("_q"))
    arr = q.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pi", "_q"))).alias("_a")) \
           .select(*keys, F.transform("_a", lambda s: s["_q"]).alias("_a"))
    return _wide(spark, arr, cols, by)


def _wide(spark, arr: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``(by, _c, _a)`` to one row per group with one array column per source column."""
    wide = arr.groupBy(*by).pivot("_c", cols).agg(F.first("_a"))
    wide = wide.select(*by, *[F.col(c) if c in wide.columns else F.lit(None).cast("array<double>").alias(c)
                              for c in cols])
    if not by:
        # a whole-table result is one row of a few numbers; keep exactly one row, also for an empty input
        rows = wide.collect()
        row = tuple(rows[0]) if rows else tuple([None] * len(cols))
        wide = spark.createDataFrame([row], ", ".join(f"`{c}` array<double>" for c in cols))
    return wide


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Whole-table quantiles, collected (a few numbers per column)."""
    rows = quantile_table(df, cols, probs).collect()
    if not rows:
        return {c: [None] * len(probs) for c in cols}
    row = rows[0]
    return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in cols}
