"""Transforms and encoders (T1-T15) split into *fit* and *apply*.

``fit_<op>(df, cols, **opts) -> params`` runs one aggregate pass and returns
plain JSON-able parameters.  ``apply_<op>(df, cols, params, suffix)`` builds
column expressions only, so applying a fitted step is a lazy projection that
Catalyst fuses with its neighbours, on batch or streaming input alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import clean_num, is_numeric
from tabloom.functions.quantile import quantile_table
from tabloom.functions.scan import row_numbers
from tabloom.session import scratch_path

MAX_CATEGORIES = 100_000  # category lists are recipe parameters and must stay small


def _out(c: str, suffix: str | None) -> str:
    return f"{c}{suffix}" if suffix else c


def _put(df: DataFrame, exprs: dict, suffix: str | None) -> DataFrame:
    return df.withColumns({_out(c, suffix): e for c, e in exprs.items()})


# ---------------------------------------------------------------- encoders

def fit_categories(df: DataFrame, cols: list[str], max_categories: int = MAX_CATEGORIES) -> dict:
    """Sorted distinct non-null values per column (numbers sorted as numbers).

    One aggregate counts the distinct values of every column first, and a
    column with more than ``max_categories`` values is refused before any
    value list is pulled; then one ordered distinct per column.
    """
    if not cols:
        return {"categories": {}}
    n = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).collect()[0]
    too_many = [c for c in cols if n[c] > max_categories]
    if too_many:
        raise ValueError(f"{too_many[0]} has {n[too_many[0]]} distinct values (> {max_categories}); "
                         "not a category column")
    cats = {}
    for c in cols:
        vals = df.select(F.col(c)).where(F.col(c).isNotNull()).distinct()
        cats[c] = [r[0] for r in vals.orderBy(c).collect()]
    return {"categories": cats}


fit_one_hot = fit_categories

PLAN_CATEGORIES = 1_000   # longer category lists are a table to join, not part of the plan


def fit_label_encode(df: DataFrame, cols: list[str], plan_limit: int = PLAN_CATEGORIES) -> dict:
    """Codes of the sorted distinct non-null values per column.

    Up to ``plan_limit`` values are a list; more are numbered by Spark and
    written as a (value, code) table to the shared folder, whose path is the
    parameter.  Any number of values can be encoded.
    """
    if not cols:
        return {"categories": {}}
    n = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).collect()[0]
    small = [c for c in cols if n[c] <= plan_limit]
    out = fit_categories(df, small, plan_limit)
    for c in cols:
        if n[c] > plan_limit:
            vals = df.select(F.col(c).alias("value")).where(F.col(c).isNotNull()).distinct()
            path = scratch_path(df.sparkSession, "categories")
            row_numbers(vals, ["value"], name="code").select("value", (F.col("code") - 1).cast("int").alias("code")) \
                .write.parquet(path)
            out["categories"][c] = None
            out.setdefault("tables", {})[c] = path
    return out


def _code_table(df: DataFrame, params: dict, c: str, value: str, code: str) -> DataFrame:
    t = df.sparkSession.read.parquet(params["tables"][c])
    return t.select(F.col("value").alias(value), F.col("code").alias(code))


def apply_label_encode(df: DataFrame, cols: list[str], params: dict, suffix: str | None = None) -> DataFrame:
    """Code 0..k-1 in sorted order; a value not seen in fitting raises an error."""
    exprs = {}
    for i, c in enumerate(cols):
        values = params["categories"][c]
        if c in params.get("tables", {}):
            df = df.join(_code_table(df, params, c, f"_v{i}", f"_n{i}"), F.col(c) == F.col(f"_v{i}"), "left")
            exprs[c] = F.when(F.col(c).isNotNull() & F.col(f"_n{i}").isNull(), F.raise_error(F.concat(
                F.lit(f"unseen label in {c}: "), F.col(c).cast("string"))).cast("int")).otherwise(F.col(f"_n{i}"))
            continue
        if not values:
            exprs[c] = F.lit(None).cast("int")
            continue
        m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
        code = F.try_element_at(m, F.col(c))
        exprs[c] = (F.when(F.col(c).isNull(), F.lit(None).cast("int"))
                    .when(code.isNull(), F.raise_error(F.concat(F.lit(f"unseen label in {c}: "),
                                                                F.col(c).cast("string"))).cast("int"))
                    .otherwise(code))
    return _put(df, exprs, suffix).drop(*[f"_{k}{i}" for i in range(len(cols)) for k in "vn"])


def apply_label_decode(df: DataFrame, cols: list[str], params: dict, suffix: str | None = None) -> DataFrame:
    """Inverse of :func:`apply_label_encode`."""
    exprs = {}
    for i, c in enumerate(cols):
        values = params["categories"][c]
        if c in params.get("tables", {}):
            df = df.join(_code_table(df, params, c, f"_v{i}", f"_n{i}"), F.col(c) == F.col(f"_n{i}"), "left")
            exprs[c] = F.col(f"_v{i}")
            continue
        arr = F.array(*[F.lit(v) for v in values])
        exprs[c] = F.when(F.col(c).isNull(), None).otherwise(F.element_at(arr, F.col(c).cast("int") + 1))
    return _put(df, exprs, suffix).drop(*[f"_{k}{i}" for i in range(len(cols)) for k in "vn"])


def dummy_name(c: str, v) -> str:
    return f"{c}_{v}"


def apply_one_hot(df: DataFrame, cols: list[str], params: dict, suffix: str | None = None) -> DataFrame:
    """One 0/1 column ``<col>_<value>`` per fitted value; null and unseen give all zeros; source dropped."""
    new = {}
    for c in cols:
        for v in params["categories"][c]:
            new[dummy_name(c, v)] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(new).drop(*cols)


def apply_reverse_one_hot(df: DataFrame, cols: list[str], params: dict, suffix: str | None = None) -> DataFrame:
    """Rebuild each source column from its dummies and drop them."""
    exprs, dummies = {}, []
    for c in cols:
        values = params["categories"][c]
        names = [dummy_name(c, v) for v in values]
        dummies += names
        exprs[c] = F.coalesce(*[F.when(F.col(n) == 1, F.lit(v)) for n, v in zip(names, values)]) \
            if values else F.lit(None)
    return df.withColumns(exprs).drop(*dummies)


# ---------------------------------------------------------------- transforms

def fit_none(df: DataFrame, cols: list[str], **_) -> dict:
    return {}


def apply_log(df, cols, params=None, suffix=None):
    return _put(df, {c: F.log1p(clean_num(c)) for c in cols}, suffix)


def apply_log_inverse(df, cols, params=None, suffix=None):
    return _put(df, {c: F.expm1(clean_num(c)) for c in cols}, suffix)


def apply_sqrt(df, cols, params=None, suffix=None):
    return _put(df, {c: F.sqrt(clean_num(c)) for c in cols}, suffix)


def _boxcox_expr(v, lam: float):
    if abs(lam) < 1e-12:
        return F.log(v)
    return (F.pow(v, F.lit(lam)) - 1) / F.lit(lam)


def boxcox_llf_grid(df: DataFrame, col: str, grid: list[float]) -> list[float]:
    """Box-Cox log-likelihood at every grid point in one pass over the column's positive values."""
    v = clean_num(col)
    # a value of 0 or less has no logarithm, so no likelihood: one such row does not end the fit of all others
    d = df.select(v.alias("_v")).where(F.col("_v") > 0)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.log("_v")).alias("sl")]
    aggs += [F.var_pop(_boxcox_expr(F.col("_v"), lam)).alias(f"v{i}") for i, lam in enumerate(grid)]
    r = d.agg(*aggs).collect()[0]
    if r["n"] == 0:
        raise ValueError(f"Box-Cox needs positive values; {col} has none")
    n, sl = r["n"], r["sl"]
    out = []
    for i, lam in enumerate(grid):
        var = r[f"v{i}"]
        out.append(-math.inf if not var or var <= 0 else (lam - 1) * sl - n / 2 * math.log(var))
    return out


def fit_box_cox(df: DataFrame, cols: list[str], lo: float = -2.0, hi: float = 2.0, **_) -> dict:
    """Maximum-likelihood lambda per column: a coarse grid, then two finer grids around the best point."""
    lambdas = {}
    for c in cols:
        step = 0.1
        grid = [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step)) + 1)]
        for _ in range(3):
            llf = boxcox_llf_grid(df, c, grid)
            best = grid[max(range(len(grid)), key=lambda i: llf[i])]
            step /= 10
            grid = [best + k * step for k in range(-10, 11)]
        lambdas[c] = best
    return {"lambda": lambdas}


def apply_box_cox(df, cols, params, suffix=None):
    """Null where the transform has no finite value: below 0, and at 0 unless lambda is positive."""
    def expr(c):
        v, lam = clean_num(c), params["lambda"][c]
        return F.when(v >= 0 if lam >= 1e-12 else v > 0, _boxcox_expr(v, lam))

    return _put(df, {c: expr(c) for c in cols}, suffix)


def fit_iqr_bounds(df: DataFrame, cols: list[str], whisker: float = 1.5, **_) -> dict:
    """Q1 - 1.5 IQR and Q3 + 1.5 IQR per column (exact, linear interpolation)."""
    q = quantile_table(df, cols, [0.25, 0.75]).collect()[0]
    bounds = {}
    for c in cols:
        q1, q3 = (q[c] or [None, None])
        if q1 is None:
            bounds[c] = [None, None]
        else:
            bounds[c] = [q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)]
    return {"bounds": bounds}


def _outside(c, b):
    v = clean_num(c)
    return (v < F.lit(b[0])) | (v > F.lit(b[1]))


def apply_remove_outliers(df, cols, params, suffix=None):
    """Drop rows with a chosen column outside its fence or missing."""
    keep = F.lit(True)
    for c in cols:
        b = params["bounds"][c]
        v = clean_num(c)
        keep = keep & v.isNotNull() & (v >= F.lit(b[0])) & (v <= F.lit(b[1]))
    return df.where(keep)


def _fit_inside_stat(df, cols, stat: str, whisker=1.5):
    bounds = fit_iqr_bounds(df, cols, whisker)["bounds"]
    fills = {}
    if stat == "mean":
        aggs = []
        for c in cols:
            v = clean_num(c)
            inside = (v >= F.lit(bounds[c][0])) & (v <= F.lit(bounds[c][1]))
            aggs.append(F.avg(F.when(inside, v)).alias(c))
        r = df.agg(*aggs).collect()[0]
        fills = {c: r[c] for c in cols}
    else:
        for c in cols:
            v = clean_num(c)
            inside = df.where((v >= F.lit(bounds[c][0])) & (v <= F.lit(bounds[c][1])))
            fills[c] = quantile_table(inside, [c], [0.5]).collect()[0][c][0]
    return {"bounds": bounds, "fill": fills}


def fit_median_impute_outliers(df, cols, whisker=1.5, **_):
    return _fit_inside_stat(df, cols, "median", whisker)


def fit_mean_impute_outliers(df, cols, whisker=1.5, **_):
    return _fit_inside_stat(df, cols, "mean", whisker)


def apply_impute_outliers(df, cols, params, suffix=None):
    """Values outside the fence (and missing ones) become the fitted inside statistic."""
    exprs = {}
    for c in cols:
        b, fill = params["bounds"][c], params["fill"][c]
        v = clean_num(c)
        exprs[c] = F.when(v.isNull() | _outside(c, b), F.lit(fill)).otherwise(v)
    return _put(df, exprs, suffix)


# ---------------------------------------------------------------- imputers

def fit_impute_mean(df, cols, **_):
    r = df.agg(*[F.avg(clean_num(c)).alias(c) for c in cols]).collect()[0]
    return {"fill": {c: r[c] for c in cols}}


def fit_impute_median(df, cols, **_):
    """Exact median (``ml.feature.Imputer`` uses an approximate one)."""
    q = quantile_table(df, cols, [0.5]).collect()[0]
    return {"fill": {c: (q[c][0] if q[c] else None) for c in cols}}


def fit_impute_mode(df, cols, **_):
    """Most frequent value, smallest on ties; text allowed.

    ``groupBy(value).count`` is a map-side-combined shuffle, so a column with
    many distinct values never sits in one task (unlike the ``mode`` aggregate).
    """
    fills = {}
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        best = counts.agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col(c).alias("v"))).alias("b")).collect()[0]["b"]
        fills[c] = None if best is None else best["v"]
    return {"fill": fills}


def fit_impute_zero(df, cols, **_):
    return {"fill": {c: 0 for c in cols}}


def apply_impute(df, cols, params, suffix=None):
    exprs = {}
    for c in cols:
        fill = params["fill"][c]
        dt = df.schema[c].dataType
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            exprs[c] = F.coalesce(clean_num(c, dt), F.lit(fill).cast("double"))
        elif is_numeric(dt) and isinstance(fill, float):
            exprs[c] = F.coalesce(F.col(c).cast("double"), F.lit(fill))
        elif is_numeric(dt):
            exprs[c] = F.coalesce(F.col(c), F.lit(fill).cast(dt))
        else:
            exprs[c] = F.coalesce(F.col(c), F.lit(fill))
    return _put(df, exprs, suffix)


# ---------------------------------------------------------------- stateless steps

def apply_drop(df, cols, params=None, suffix=None):
    return df.drop(*[c for c in cols if c in df.columns])


def apply_to_int(df, cols, params=None, suffix=None):
    from tabloom.operators.clean import to_int
    return to_int(df, cols, suffix)


def apply_to_float(df, cols, params=None, suffix=None):
    from tabloom.operators.clean import to_float
    return to_float(df, cols, suffix)


def apply_to_string(df, cols, params=None, suffix=None):
    from tabloom.operators.clean import to_string
    return to_string(df, cols, suffix)


def apply_remove_symbols(df, cols, params=None, suffix=None):
    from tabloom.operators.clean import remove_symbols
    return remove_symbols(df, cols, suffix)


def apply_to_datetime(df, cols, params=None, suffix=None):
    from tabloom.operators.clean import to_datetime
    return to_datetime(df, cols, (params or {}).get("format"), suffix)


# op name -> (fit, apply, preview suffix, inverse apply or None)
OPS = {
    "label_encode": (fit_label_encode, apply_label_encode, "_label", apply_label_decode),
    "one_hot": (fit_one_hot, apply_one_hot, None, apply_reverse_one_hot),
    "log": (fit_none, apply_log, "_log", apply_log_inverse),
    "log_inverse": (fit_none, apply_log_inverse, "_exp", apply_log),
    "sqrt": (fit_none, apply_sqrt, "_sqrt", None),
    "box_cox": (fit_box_cox, apply_box_cox, "_boxcox", None),
    "remove_outliers": (fit_iqr_bounds, apply_remove_outliers, None, None),
    "median_impute_outliers": (fit_median_impute_outliers, apply_impute_outliers, "_median_outliers", None),
    "mean_impute_outliers": (fit_mean_impute_outliers, apply_impute_outliers, "_mean_outliers", None),
    "impute_median": (fit_impute_median, apply_impute, "_median_imputed", None),
    "impute_mean": (fit_impute_mean, apply_impute, "_mean_imputed", None),
    "impute_mode": (fit_impute_mode, apply_impute, "_mode_imputed", None),
    "impute_zero": (fit_impute_zero, apply_impute, "_zero_imputed", None),
    "drop_columns": (fit_none, apply_drop, None, None),
    "to_int": (fit_none, apply_to_int, "_int", None),
    "to_float": (fit_none, apply_to_float, "_float", None),
    "to_string": (fit_none, apply_to_string, "_string", None),
    "remove_symbols": (fit_none, apply_remove_symbols, "_symbol_removed", None),
    "to_datetime": (fit_none, apply_to_datetime, "_date_formated", None),
}

# steps that refuse a column with nulls (log, sqrt and Box-Cox)
NULL_GUARDED = {"log", "sqrt", "box_cox"}


def fit_transform(df: DataFrame, op: str, cols: list[str], suffix: str | None = None, **opts):
    """Fit ``op`` on ``df`` and apply it; returns ``(DataFrame, params)``."""
    fit, apply, _, _ = OPS[op]
    params = fit(df, cols, **opts)
    return apply(df, cols, params, suffix), params
