"""Running sums and row numbers without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` pulls every row into one task.
Here rows are cut into ordered buckets by range bounds over all order columns
(a sample's quantiles, collected once as one array literal and searched by
halving), running sums are computed inside each ``(bucket, group)``, and the
totals of the earlier buckets of the same group (a table of buckets x groups)
are added back with a join.  Bounds are compared in the columns' own types and
Spark's own order, so text, long integers and decimals are exact, and a value
that fills many buckets is split by the next order column.  The bucket is a
pure function of the row, so every branch of the plan and every recomputation
after an executor loss agree on it.  The rows are counted first; a table of at
most ``SMALL_ROWS`` is one window per group, with the same result.  Where the
first order column is a hash of the row's key (``hashed``), its leading digits
are the bucket: no sample is drawn and no bounds are searched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PER_BUCKET = 60   # sampled rows per bucket when choosing bounds
SMALL_ROWS = 200_000     # tables up to this size are ordered in one task: buckets would cost more than they spread


def search_sorted(bounds: Column, value: Column, n: int) -> Column:
    """How many of the ``n`` ascending ``bounds`` are <= ``value``, by halving."""
    if n == 0:
        return F.lit(0)
    steps = max(1, math.ceil(math.log2(n + 1)))
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= value)
        return F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(above | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lo"])


def with_place(df: DataFrame, name: str, bounds: Column, value: Column, n: int) -> DataFrame:
    """Append :func:`search_sorted`.

    As a one-row generator: the search is done once per row and never copied
    into the aggregates and joins above it.
    """
    return df.select("*", F.explode(F.array(search_sorted(bounds, value, n))).alias(name))


def _bounds(df: DataFrame, cols: list[str], n: int, total: int | None = None) -> list:
    """At most ``n - 1`` ascending rows of ``cols`` that cut ``df`` into about equal parts."""
    keys = df.select(*cols)
    total = keys.count() if total is None else total
    want = SAMPLE_PER_BUCKET * n
    if total == 0 or n < 2:
        return []
    some = keys if total <= want else keys.sample(fraction=min(1.0, want / total), seed=7)
    # the sample (about `want` rows) is ranked in one task; only the bounds reach the driver
    ranked = some.select("*", F.ntile(n).over(Window.orderBy(*cols)).alias("_nt"))
    rows = ranked.groupBy("_nt").agg(F.min(F.struct(*cols)).alias("_b")).orderBy("_nt").collect()
    out = []
    for r in rows[1:]:
        b = tuple(r["_b"])
        if not out or out[-1] != b:
            out.append(b)
    return out


def order_buckets(df: DataFrame, cols: list[str], n: int, name: str = "_bk", total: int | None = None) -> DataFrame:
    """Append ``name``: an ordered bucket 0..n-1 of the rows by ``cols`` (Spark's order: nulls first, NaN last)."""
    bounds = _bounds(df, cols, n, total)
    if not bounds:
        return df.withColumn(name, F.lit(0))
    types = [df.schema[c].dataType for c in cols]

    def row(b):
        return F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, types))])

    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
    return with_place(df, name, F.array(*[row(b) for b in bounds]), key, len(bounds))


def hash_bucket(df: DataFrame, col: str, n: int) -> Column:
    """Bucket 0..n-1 in the order of an even hash: hex text or a signed 64-bit number (null first)."""
    if isinstance(df.schema[col].dataType, T.StringType):
        digits = F.conv(F.substring(col, 1, 4), 16, 10).cast("bigint")
    else:
        digits = F.shiftright(F.col(col), 48) + F.lit(32768)
    return F.coalesce(F.floor(digits * F.lit(n) / F.lit(65536)).cast("int"), F.lit(0))


def prefix_sums(df: DataFrame, order_cols: list[str], value_cols: dict[str, str],
                group_cols: list[str] = (), inclusive: bool = True,
                num_partitions: int | None = None, hashed: bool = False) -> DataFrame:
    """Append running sums ``{out_name: source_col}`` in ``(group_cols, order_cols)`` order.

    ``order_cols`` must be a total order inside each group (add a tie-breaker
    key); the sums restart for every group.  ``inclusive=False`` gives the sum
    of the strictly earlier rows.  ``hashed``: the first order column is an
    even hash of the other ones (see :func:`hash_bucket`).
    """
    group_cols = list(group_cols)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    if total <= SMALL_ROWS and num_partitions is None:
        rows = Window.partitionBy(*group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = {out: F.sum(F.col(src)).over(rows) - (F.lit(0) if inclusive else F.col(src)) for out, src in value_cols.items()}
        return df.select(*[df[c] for c in df.columns if c not in value_cols], *[v.alias(out) for out, v in running.items()])
    if hashed:
        bucketed = df.withColumn("_bk", hash_bucket(df, order_cols[0], n))
    else:
        bucketed = order_buckets(df, list(order_cols), n, total=total)

    frame = Window.partitionBy("_bk", *group_cols).orderBy(*order_cols)
    frame = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed
    for out, src in value_cols.items():
        local = local.withColumn(f"_loc_{out}", F.sum(F.col(src)).over(frame))

    totals = bucketed.groupBy("_bk", *group_cols).agg(
        *[F.sum(F.col(src)).alias(f"_tot_{out}") for out, src in value_cols.items()])
    before = Window.partitionBy(*group_cols).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bk", *group_cols,
        *[F.coalesce(F.sum(f"_tot_{out}").over(before), F.lit(0)).alias(f"_off_{out}") for out in value_cols])

    cond = [local["_bk"] == offsets["_bk"]] + [local[g].eqNullSafe(offsets[g]) for g in group_cols]
    joined = local.join(offsets, on=cond, how="inner")
    outs = []
    for out, src in value_cols.items():
        running = F.col(f"_off_{out}") + F.col(f"_loc_{out}")
        if not inclusive:
            running = running - local[src]
        outs.append(running.alias(out))
    keep = [local[c] for c in df.columns if c not in value_cols]
    return joined.select(*keep, *outs)


def row_numbers(df: DataFrame, order_cols: list[str], group_cols: list[str] = (),
                name: str = "row_number", num_partitions: int | None = None, hashed: bool = False) -> DataFrame:
    """1-based row number in ``(group_cols, order_cols)`` order, distributed."""
    with_one = df.withColumn("_one", F.lit(1).cast("bigint"))
    out = prefix_sums(with_one, order_cols, {name: "_one"}, group_cols, True, num_partitions, hashed)
    return out.drop("_one")
