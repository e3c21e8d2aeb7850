"""Profiling and chart-data operators (summary tables behind each chart).

Aggregates over many columns are fused into one pass; multi-column
group-bys use an unpivot (``stack``) so one shuffle serves every column.
Only per-column statistics reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import FLOAT_TYPES, clean_num, pearson, is_numeric, numeric_columns
from tabloom.functions.quantile import quantile_table, quantiles
from tabloom.session import compiled_methods

DESCRIBE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("dtype", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("missing", T.LongType()),
    T.StructField("unique", T.LongType()), T.StructField("top", T.StringType()),
    T.StructField("freq", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()), T.StructField("min", T.DoubleType()),
    T.StructField("p25", T.DoubleType()), T.StructField("p50", T.DoubleType()),
    T.StructField("p75", T.DoubleType()), T.StructField("max", T.DoubleType()),
])


def _stack(pairs: list[tuple[str, "F.Column"]], name_col: str, value_col: str) -> "F.Column":
    """``stack(n, 'a', expr_a, 'b', expr_b, ...)`` as one generator column."""
    args = []
    for name, expr in pairs:
        args.extend([F.lit(name), expr])
    return F.stack(F.lit(len(pairs)), *args).alias(name_col, value_col)


def top_values(df: DataFrame, cols: list[str]) -> dict[str, tuple[str | None, int | None, int]]:
    """Most frequent non-null value per column (smallest on ties), its count, and the distinct count.

    One shuffle for all columns: unpivot to ``(column, value)``, count with
    map-side combine, then keep the best value per column; the number of
    ``(column, value)`` groups is each column's distinct count.
    """
    if not cols:
        return {}
    long = df.select(_stack([(c, F.col(c).cast("string")) for c in cols], "_c", "_v"))
    counts = long.where(F.col("_v").isNotNull()).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("_c").agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_v").alias("v"))).alias("b"),
                                    F.count(F.lit(1)).alias("d"))
    out = {c: (None, None, 0) for c in cols}
    for r in best.collect():
        out[r["_c"]] = (r["b"]["v"], -r["b"]["neg"], r["d"])
    return out


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: count, missing, unique/top/freq (text), moments and quartiles (numbers)."""
    spark = df.sparkSession
    cols = cols or df.columns
    types = {c: df.schema[c].dataType for c in cols}
    nums = [c for c in cols if is_numeric(types[c])]
    cats = [c for c in cols if not is_numeric(types[c])]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in nums:
        v = clean_num(c, types[c])
        aggs += [F.count(v).alias(f"{c}__count"), F.avg(v).alias(f"{c}__mean"),
                 F.stddev_samp(v).alias(f"{c}__std"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    for c in cats:
        aggs += [F.count(F.col(c)).alias(f"{c}__count")]
    stats = df.agg(*aggs).collect()[0]
    qs = quantiles(df, nums, [0.25, 0.5, 0.75]) if nums else {}
    tops = top_values(df, cats)
    rows = []
    n = stats["_rows"]
    for c in cols:
        cnt = stats[f"{c}__count"]
        if c in nums:
            q = qs[c]
            std = stats[f"{c}__std"]
            std = None if std is None or (isinstance(std, float) and math.isnan(std)) else std
            rows.append((c, types[c].simpleString(), cnt, n - cnt, None, None, None, stats[f"{c}__mean"], std,
                         stats[f"{c}__min"], q[0], q[1], q[2], stats[f"{c}__max"]))
        else:
            top, freq, unique = tops[c]
            rows.append((c, types[c].simpleString(), cnt, n - cnt, unique, top, freq,
                         None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, DESCRIBE_SCHEMA)


def describe_column(df: DataFrame, col: str, nbins: int = 10) -> dict[str, DataFrame]:
    """Everything about one column: summary row, distinct/missing, distribution and correlations."""
    out = {"summary": describe(df, [col]), "column": column_list(df.select(col))}
    if is_numeric(df.schema[col].dataType):
        out["histogram"] = histogram(df, col, nbins)
        others = [c for c in numeric_columns(df) if c != col]
        if others:
            out["correlations"] = corr_with(df, col, others)
    else:
        out["counts"] = count_values(df, col)
    return out


def distinct_counts(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, int]]:
    """Column -> (distinct non-null values, missing rows), exact.

    One unpivot to (column, value as text), combined on the map side: each distinct value of each
    column is shuffled once per task, and no row is copied per column as several exact distinct
    aggregates would.  Text keeps atomic values apart (-0.0 counts as 0.0); nested ones are counted
    by Spark's own aggregate.
    """
    flat = [c for c in cols if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.UserDefinedType))]
    out = {}
    if flat:
        pairs = []
        for i, c in enumerate(flat):
            dt, v = df.schema[c].dataType, F.col(c)
            v = F.hex(v) if isinstance(dt, T.BinaryType) else (v + F.lit(0).cast(dt)) if isinstance(dt, FLOAT_TYPES) else v
            pairs += [F.lit(i), v.cast("string")]
        values = df.select(F.stack(F.lit(len(flat)), *pairs).alias("c", "v")).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        got = {r["c"]: (r["d"], r["m"]) for r in values.groupBy("c").agg(
            F.count("v").alias("d"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("m")).collect()}
        out.update({c: got.get(i, (0, 0)) for i, c in enumerate(flat)})
    for c in cols:
        if c not in out:
            r = df.agg(F.count_distinct(F.col(c)).alias("d"), F.count_if(F.col(c).isNull()).alias("m")).first()
            out[c] = (r["d"], r["m"])
    return out


def column_list(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: dtype, number of distinct non-null values, number missing.

    ``approx=True`` counts distinct values with HyperLogLog (one pass, a few
    KB of state per column) instead of the exact distinct aggregation.
    """
    cols = df.columns
    if approx:
        r = df.agg(*[x for c in cols for x in (F.approx_count_distinct(F.col(c)).alias(f"{c}__d"),
                                               F.count_if(F.col(c).isNull()).alias(f"{c}__m"))]).collect()[0]
        counts = {c: (r[f"{c}__d"], r[f"{c}__m"]) for c in cols}
    else:
        counts = distinct_counts(df, cols)
    rows = [(c, df.schema[c].dataType.simpleString(), *counts[c]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, distinct bigint, missing bigint")


# Distinct-count limits of the problem-type rule.
INT_CLASS_LIMIT = 30
FLOAT_CLASS_LIMIT = 15


def _problem_rule(dt: T.DataType, n_unique: int) -> str:
    if isinstance(dt, (T.ShortType, T.IntegerType, T.LongType)):
        limit = INT_CLASS_LIMIT
    elif isinstance(dt, FLOAT_TYPES):
        limit = FLOAT_CLASS_LIMIT
    else:
        return "Binary_Classification" if n_unique <= 2 else "Multi_Classification"
    if n_unique <= 2:
        return "Binary_Classification"
    return "Multi_Classification" if n_unique <= limit else "Regression"


def problem_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Problem type each column would give as a target; a null counts as a value."""
    cols = cols or df.columns
    counts = distinct_counts(df, cols)
    rows = []
    for c in cols:
        n_unique = counts[c][0] + (counts[c][1] > 0)
        dt = df.schema[c].dataType
        rows.append((c, dt.simpleString(), n_unique, _problem_rule(dt, n_unique)))
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, n_unique bigint, problem_type string")


def infer_problem_type(df: DataFrame, target: str) -> str:
    return problem_types(df, [target]).collect()[0]["problem_type"]


def _bin_expr(v, lo: float, width: float, nbins: int):
    idx = F.floor((v - F.lit(lo)) / F.lit(width))
    return F.when(v.isNull(), None).otherwise(F.least(F.greatest(idx, F.lit(0)), F.lit(nbins - 1)))


def histogram(df: DataFrame, col: str, nbins: int = 10) -> DataFrame:
    """Equal-width bins from min to max (last bin closed): bin, lower, upper, count, density."""
    v = clean_num(col, df.schema[col].dataType)
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).collect()[0]
    lo, hi, n = r["lo"], r["hi"], r["n"]
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], "bin bigint, lower double, upper double, count bigint, density double")
    width = (hi - lo) / nbins if hi > lo else 1.0
    counts = (df.select(_bin_expr(v, lo, width, nbins).alias("bin")).where(F.col("bin").isNotNull())
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    return counts.select(
        F.col("bin").cast("bigint").alias("bin"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.col("count"),
        (F.col("count") / F.lit(n * width)).alias("density"))


def kde(df: DataFrame, col: str, grid_points: int = 50, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid from min to max.

    Bandwidth defaults to Scott's rule, ``std * n^(-1/5)``.  The grid is a
    handful of literal points, so every point's density is one aggregate
    expression of a single pass (no join of grid and rows).
    """
    v = clean_num(col, df.schema[col].dataType)
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"),
               F.stddev_samp(v).alias("sd")).collect()[0]
    lo, hi, n, sd = r["lo"], r["hi"], r["n"], r["sd"]
    spark = df.sparkSession
    if not n or sd is None or sd == 0 or math.isnan(sd):
        return spark.createDataFrame([], "point bigint, x double, density double")
    h = bandwidth or sd * n ** (-0.2)
    step = (hi - lo) / (grid_points - 1)
    grid = [lo + i * step for i in range(grid_points)]
    aggs = [F.sum(F.exp(-0.5 * F.pow((F.lit(g) - v) / F.lit(h), 2))).alias(f"g{i}") for i, g in enumerate(grid)]
    sums = df.agg(*aggs)
    norm = n * h * math.sqrt(2 * math.pi)
    long = sums.select(_stack([(str(i), F.col(f"g{i}")) for i in range(grid_points)], "point", "s"))
    return long.select(F.col("point").cast("bigint").alias("point"),
                       (F.lit(lo) + F.col("point").cast("bigint") * F.lit(step)).alias("x"),
                       (F.col("s") / F.lit(norm)).alias("density"))


def box_stats(df: DataFrame, col: str, by: list[str] = (), whisker: float = 1.5) -> DataFrame:
    """Quartiles, fences, whisker ends (most extreme values inside the fences) and outlier count per group.

    The quartile table (one row per group) is computed once and joined to the
    values once; the quartiles ride through the final aggregate.
    """
    by = list(by)
    q = quantile_table(df, [col], [0.25, 0.5, 0.75], by)
    q = q.select(*by, F.col(col)[0].alias("q1"), F.col(col)[1].alias("median"), F.col(col)[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("lower_fence", F.col("q1") - whisker * F.col("iqr")) \
         .withColumn("upper_fence", F.col("q3") + whisker * F.col("iqr"))
    stat_cols = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    v = clean_num(col, df.schema[col].dataType)
    data = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    if by:
        qr = q.select(*[F.col(b).alias(f"_q_{b}") for b in by], *stat_cols)
        cond = [data[b].eqNullSafe(qr[f"_q_{b}"]) for b in by]
        j = data.join(qr, on=cond, how="inner").drop(*[f"_q_{b}" for b in by])
    else:
        # whole-table fences are a few numbers: inline them instead of joining
        row = q.collect()[0]
        j = data.withColumns({k: F.lit(row[k]) for k in stat_cols})
    inside = (F.col("_v") >= F.col("lower_fence")) & (F.col("_v") <= F.col("upper_fence"))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.first(k).alias(k) for k in stat_cols],
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def count_values(df: DataFrame, x: str, color: str | None = None) -> DataFrame:
    keys = [x] + ([color] if color else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def pie(df: DataFrame, values: str, names: str) -> DataFrame:
    """Sum of ``values`` per ``names`` and its share of the grand total."""
    total = df.agg(F.sum(F.col(values)).alias("t")).collect()[0]["t"]
    g = df.groupBy(names).agg(F.sum(F.col(values)).alias("total"))
    return g.withColumn("share", F.col("total") / F.lit(total))


CORR_PLAN = 12  # up to so many columns every pair is an expression of one aggregate; the rule is the same beyond


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete rows), long form; null where a column does not vary."""
    cols = cols or numeric_columns(df)
    types = {c: df.schema[c].dataType for c in cols}
    x = [clean_num(c, types[c]) for c in cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if len(cols) <= CORR_PLAN:
        r = df.agg(*[pearson(x[i], x[j]).alias(f"{i}__{j}") for i, j in pairs]).collect()[0]
        vals = {(i, j): r[f"{i}__{j}"] for i, j in pairs}
    else:
        vals = _wide_corr(df, x)
    vals = {k: None if v is None or math.isnan(v) else float(v) for k, v in vals.items()}
    rows = [(a, b, vals[min(i, j), max(i, j)]) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


# rows that give a first idea of means and deviations before the pass over all rows
CENTRE_ROWS = 1000


def _wide_corr(df: DataFrame, x: list) -> dict:
    """Pairwise-complete sums by one matrix product per batch, added up by Spark per pair.

    Each task holds a few p x p matrices.  Columns are centred and scaled by the mean and deviation of
    a few rows first; where those turn out so far off that digits were lost, the pass is repeated once
    around the means it has found.
    """
    import numpy as np
    cols = df.select(*[c.alias(f"c{i}") for i, c in enumerate(x)])
    p = len(x)
    few = np.array([[np.nan if v is None else v for v in r] for r in cols.limit(CENTRE_ROWS).collect()], float).reshape(-1, p)
    has = ~np.isnan(few)
    n = np.maximum(has.sum(0), 1)
    mean = np.where(has, few, 0.0).sum(0) / n
    dev = np.sqrt((np.where(has, few - mean, 0.0) ** 2).sum(0) / n)
    dev[dev == 0] = 1.0
    for _ in range(2):
        sums = _pair_sums(cols, p, mean, dev)
        own = np.arange(p)
        k, s, q = (sums[c][own, own] for c in ("n", "sx", "sxx"))
        off = s / np.maximum(k, 1)
        var = q / np.maximum(k, 1) - off * off
        if not ((off * off > 1e6 * np.maximum(var, 0)) & (off != 0)).any():
            break
        mean, dev = mean + off * dev, np.where(var > 0, dev * np.sqrt(np.maximum(var, 1e-300)), dev)
    n, sx, sy, sxx, syy, sxy = (sums[c] for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    out = {}
    for i in range(p):
        for j in range(i, p):
            m = n[i, j]
            vx, vy = (sxx[i, j] - sx[i, j] ** 2 / m, syy[i, j] - sy[i, j] ** 2 / m) if m else (0.0, 0.0)
            varies = min(vx, vy) > 1e-12 * max(1.0, m)
            out[i, j] = (sxy[i, j] - sx[i, j] * sy[i, j] / m) / math.sqrt(vx * vy) if varies else None
    return out


def _pair_sums(cols: DataFrame, p: int, mean, dev) -> dict:
    """name -> p x p sums over the rows that have both columns, of centred and scaled values."""
    import numpy as np
    import pyarrow as pa
    left, right = np.triu_indices(p)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(batches):
        total = np.zeros((6, len(left)))
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns])
            v = (v - mean) / dev
            has = ~np.isnan(v)
            v[~has] = 0.0
            w, sq = has.astype(float), v * v
            a, q = v.T @ w, sq.T @ w
            for k, m in enumerate((w.T @ w, a, a.T, q, q.T, v.T @ v)):
                total[k] += m[left, right]
        yield pa.record_batch([pa.array(left, pa.int32()), pa.array(right, pa.int32()), *map(pa.array, total)],
                              names=["i", "j", *names])

    parts = cols.mapInArrow(sums, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    with compiled_methods(cols.sparkSession):
        got = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = {c: np.zeros((p, p)) for c in names}
    for c in names:
        out[c][got["i"].to_numpy(), got["j"].to_numpy()] = got[c].to_numpy()
    return out


def corr_with(df: DataFrame, target: str, cols: list[str] | None = None, keep_self: bool = False) -> DataFrame:
    """Correlation of each numeric column with ``target``, ranked by absolute value."""
    cols = cols or numeric_columns(df)
    if not keep_self:
        cols = [c for c in cols if c != target]
    elif target not in cols:
        cols = cols + [target]
    types = {c: df.schema[c].dataType for c in cols + [target]}
    tgt = clean_num(target, types[target])
    r = df.agg(*[pearson(clean_num(c, types[c]), tgt).alias(c) for c in cols]).collect()[0]
    vals = [(c, None if r[c] is None or math.isnan(r[c]) else float(r[c])) for c in cols]
    ordered = sorted(vals, key=lambda t: (-(abs(t[1]) if t[1] is not None else -1), t[0]))
    rows = [(c, v, i + 1) for i, (c, v) in enumerate(ordered)]
    return df.sparkSession.createDataFrame(rows, "column string, corr double, rank bigint")


def scatter_bins(df: DataFrame, x: str, y: str, nx: int = 20, ny: int = 20,
                 color: str | None = None) -> DataFrame:
    """2-D binned scatter: count of points per (x bin, y bin[, color])."""
    vx, vy = clean_num(x, df.schema[x].dataType), clean_num(y, df.schema[y].dataType)
    r = df.agg(F.min(vx).alias("x0"), F.max(vx).alias("x1"), F.min(vy).alias("y0"), F.max(vy).alias("y1")).collect()[0]
    wx = (r["x1"] - r["x0"]) / nx if r["x1"] > r["x0"] else 1.0
    wy = (r["y1"] - r["y0"]) / ny if r["y1"] > r["y0"] else 1.0
    keys = [_bin_expr(vx, r["x0"], wx, nx).alias("x_bin"), _bin_expr(vy, r["y0"], wy, ny).alias("y_bin")]
    if color:
        keys.append(F.col(color))
    g = (df.select(*keys).where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
         .groupBy(*[k for k in ["x_bin", "y_bin"] + ([color] if color else [])]).agg(F.count(F.lit(1)).alias("count")))
    return g.select(F.col("x_bin").cast("bigint").alias("x_bin"), F.col("y_bin").cast("bigint").alias("y_bin"),
                    *([color] if color else []),
                    (F.lit(r["x0"]) + F.col("x_bin") * F.lit(wx)).alias("x_lower"),
                    (F.lit(r["y0"]) + F.col("y_bin") * F.lit(wy)).alias("y_lower"), "count")


def scatter_sample(df: DataFrame, x: str, y: str, fraction: float, seed: int = 0,
                   key: str | None = None, color: str | None = None) -> DataFrame:
    """Deterministic hash sample of points (the sample is the feature)."""
    from tabloom.functions.exprs import hash_int
    cols = [x, y] + ([color] if color else [])
    if key is None:
        return df.select(*cols).sample(fraction=fraction, seed=seed)
    keep = hash_int(F.col(key), seed, 8) < F.lit(int(fraction * 16 ** 8))
    return df.where(keep).select(key, *cols)


def line(df: DataFrame, x: str, y: str, agg: str = "avg") -> DataFrame:
    """Line chart data: ``y`` aggregated per distinct ``x`` (sort by x when plotting)."""
    fn = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg]
    return df.groupBy(x).agg(fn(F.col(y)).alias(y), F.count(F.lit(1)).alias("n"))


def graph_view(df: DataFrame, nbins: int = 10, max_categories: int = 10) -> DataFrame:
    """Histogram for every numeric column and value counts for text/boolean columns with < ``max_categories`` values.

    Long form ``(column, kind, bin, lower, upper, category, count)``; one
    pass for the ranges, one shuffle for all the counts.
    """
    spark = df.sparkSession
    nums = numeric_columns(df)
    cats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    aggs = []
    for c in nums:
        v = clean_num(c, df.schema[c].dataType)
        aggs += [F.min(v).alias(f"{c}__lo"), F.max(v).alias(f"{c}__hi")]
    for c in cats:
        aggs.append(F.count_distinct(F.col(c)).alias(f"{c}__d"))
    r = df.agg(*aggs).collect()[0] if aggs else None
    cats = [c for c in cats if r[f"{c}__d"] < max_categories]
    pairs = []
    edges = {}
    for c in nums:
        lo, hi = r[f"{c}__lo"], r[f"{c}__hi"]
        if lo is None:
            continue
        width = (hi - lo) / nbins if hi > lo else 1.0
        edges[c] = (lo, width)
        v = clean_num(c, df.schema[c].dataType)
        pairs.append((c, F.struct(F.lit("hist").alias("kind"), _bin_expr(v, lo, width, nbins).cast("bigint").alias("bin"),
                                  F.lit(None).cast("string").alias("category"))))
    for c in cats:
        pairs.append((c, F.struct(F.lit("count").alias("kind"), F.lit(None).cast("bigint").alias("bin"),
                                  F.col(c).cast("string").alias("category"))))
    if not pairs:
        return spark.createDataFrame([], "column string, kind string, bin bigint, lower double, upper double, "
                                         "category string, count bigint")
    long = df.select(_stack(pairs, "column", "s")).select("column", "s.kind", "s.bin", "s.category")
    long = long.where(~((F.col("kind") == "hist") & F.col("bin").isNull()))
    counts = long.groupBy("column", "kind", "bin", "category").agg(F.count(F.lit(1)).alias("count"))
    lo_map = F.create_map(*[x for c, (lo, w) in edges.items() for x in (F.lit(c), F.lit(lo))]) if edges else None
    w_map = F.create_map(*[x for c, (lo, w) in edges.items() for x in (F.lit(c), F.lit(w))]) if edges else None
    if edges:
        lower = F.when(F.col("kind") == "hist", F.element_at(lo_map, F.col("column")) + F.col("bin") * F.element_at(w_map, F.col("column")))
        upper = F.when(F.col("kind") == "hist", F.element_at(lo_map, F.col("column")) + (F.col("bin") + 1) * F.element_at(w_map, F.col("column")))
    else:
        lower = upper = F.lit(None).cast("double")
    return counts.select("column", "kind", "bin", lower.cast("double").alias("lower"),
                         upper.cast("double").alias("upper"), "category", "count")


def gram_matrix(df: DataFrame, cols: list[str], centered: bool = False) -> np.ndarray:
    """``X'X`` (or the covariance matrix) over rows with no null in ``cols``, one pass."""
    types = {c: df.schema[c].dataType for c in cols}
    vals = {c: clean_num(c, types[c]) for c in cols}
    complete = df.select(*[vals[c].alias(c) for c in cols]).dropna()
    aggs = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            e = F.covar_pop(F.col(a), F.col(b)) if centered else F.sum(F.col(a) * F.col(b))
            aggs.append(e.alias(f"{i}_{j}"))
    r = complete.agg(*aggs).collect()[0]
    p = len(cols)
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = r[f"{i}_{j}"] or 0.0
    return g


def vif(df: DataFrame, cols: list[str] | None = None, centered: bool = False) -> DataFrame:
    """Variance inflation per feature, descending.

    Uncentred by default (regression of each column on the others without an
    intercept): ``VIF_j = G_jj * inv(G)_jj`` from the Gram matrix.
    """
    cols = cols or numeric_columns(df)
    g = gram_matrix(df, cols, centered)
    try:
        inv = np.linalg.inv(g)
        vals = [float(g[j, j] * inv[j, j]) for j in range(len(cols))]
    except np.linalg.LinAlgError:
        vals = [float("inf")] * len(cols)
    rows = sorted(zip(cols, vals), key=lambda t: -t[1])
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def outlier_rate(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Percent of rows with any chosen column outside its ``(lower, upper)`` fence."""
    outside = F.lit(False)
    for c, (lo, hi) in bounds.items():
        v = clean_num(c, df.schema[c].dataType)
        outside = outside | F.coalesce((v < F.lit(lo)) | (v > F.lit(hi)), F.lit(False))
    return df.agg((F.avg(outside.cast("double")) * 100).alias("outlier_pct"),
                  F.count_if(outside).alias("n_outliers"), F.count(F.lit(1)).alias("n_rows"))


__all__ = ["describe", "column_list", "problem_types", "infer_problem_type", "histogram", "kde", "box_stats",
           "count_values", "pie", "corr_matrix", "corr_with", "scatter_bins", "scatter_sample", "line",
           "graph_view", "gram_matrix", "vif", "outlier_rate", "top_values", "describe_column"]
