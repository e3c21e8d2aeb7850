"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts read as missing (pandas' default NA words plus a
# single space, read as missing on every load).
NA_TOKENS = ["", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Characters removed before a text-to-number cast.
SYMBOLS = r"[ ?,!/;:$]"          # remove_symbols
SYMBOLS_WITH_QUOTE = r"[ ?,!/;:$']"  # to_float

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def clean_num(name: str, dt: T.DataType | None = None) -> Column:
    """Column as double with NaN turned into null (Spark aggregates skip nulls, not NaN)."""
    c = F.col(name)
    if dt is not None and isinstance(dt, INTEGRAL_TYPES):
        return c.cast("double")
    c = c.cast("double")
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two doubles over rows with both; null where one of them does not vary."""
    vx = F.var_pop(F.when(y.isNotNull(), x))
    vy = F.var_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy))


def na_to_null(c: Column, tokens=NA_TOKENS) -> Column:
    """Text cell to null when it is one of the NA words."""
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def strip_symbols(c: Column, with_quote: bool = False) -> Column:
    return F.regexp_replace(c, SYMBOLS_WITH_QUOTE if with_quote else SYMBOLS, "")


def hash_hex(key: Column, seed: int | str) -> Column:
    """md5 of ``'<seed>:<key>'``: a stable per-row hash that another engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_int(key: Column, seed: int | str, digits: int = 8) -> Column:
    """First ``digits`` hex digits of :func:`hash_hex` as a bigint."""
    return F.conv(F.substring(hash_hex(key, seed), 1, digits), 16, 10).cast("bigint")


def row_key(cols: list[str]) -> Column:
    """Stable key text for a multi-column key (no monotonically_increasing_id)."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in cols])


def hash_threshold(pct: float) -> str:
    """Four-hex-digit threshold for a ``pct`` percent hash split."""
    return format(int(round(65536 * pct / 100.0)), "04x")


def norm_ppf(p: Column) -> Column:
    """Inverse standard normal CDF (rational approximation, |rel err| < 1.2e-9).

    Written with column arithmetic so it stays inside whole-stage codegen.
    """
    # Coefficients of the published rational approximation.
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
    plow = 0.02425

    def tail(q):
        num = ((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]
        den = (((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1
        return num / den

    q_lo = F.sqrt(-2 * F.log(p))
    q_hi = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    r = q * q
    central = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / \
              (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    return (F.when(p < plow, tail(q_lo))
            .when(p > 1 - plow, -tail(q_hi))
            .otherwise(central))


def hash_unit(*cols) -> Column:
    """Deterministic uniform number in (0, 1) from a hash of ``cols``."""
    return (F.pmod(F.xxhash64(*cols), F.lit(2 ** 52)).cast("double") + 0.5) / F.lit(float(2 ** 52))


def gauss(*cols) -> Column:
    """Deterministic standard normal deviate from a hash of ``cols`` (Box-Muller, small codegen)."""
    u1 = hash_unit(F.lit(1), *cols)
    u2 = hash_unit(F.lit(2), *cols)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)


NORM_PPF_SQL = """CASE WHEN {p} < 0.02425 THEN
  (((((-7.784894002430293e-03 * sqrt(-2 * ln({p})) + -3.223964580411365e-01) * sqrt(-2 * ln({p})) + -2.400758277161838e+00) * sqrt(-2 * ln({p})) + -2.549732539343734e+00) * sqrt(-2 * ln({p})) + 4.374664141464968e+00) * sqrt(-2 * ln({p})) + 2.938163982698783e+00)
  / ((((7.784695709041462e-03 * sqrt(-2 * ln({p})) + 3.224671290700398e-01) * sqrt(-2 * ln({p})) + 2.445134137142996e+00) * sqrt(-2 * ln({p})) + 3.754408661907416e+00) * sqrt(-2 * ln({p})) + 1)
WHEN {p} > 1 - 0.02425 THEN
  -((((((-7.784894002430293e-03 * sqrt(-2 * ln(1 - {p})) + -3.223964580411365e-01) * sqrt(-2 * ln(1 - {p})) + -2.400758277161838e+00) * sqrt(-2 * ln(1 - {p})) + -2.549732539343734e+00) * sqrt(-2 * ln(1 - {p})) + 4.374664141464968e+00) * sqrt(-2 * ln(1 - {p})) + 2.938163982698783e+00)
  / ((((7.784695709041462e-03 * sqrt(-2 * ln(1 - {p})) + 3.224671290700398e-01) * sqrt(-2 * ln(1 - {p})) + 2.445134137142996e+00) * sqrt(-2 * ln(1 - {p})) + 3.754408661907416e+00) * sqrt(-2 * ln(1 - {p})) + 1))
ELSE
  (((((-3.969683028665376e+01 * (({p} - 0.5) * ({p} - 0.5)) + 2.209460984245205e+02) * (({p} - 0.5) * ({p} - 0.5)) + -2.759285104469687e+02) * (({p} - 0.5) * ({p} - 0.5)) + 1.383577518672690e+02) * (({p} - 0.5) * ({p} - 0.5)) + -3.066479806614716e+01) * (({p} - 0.5) * ({p} - 0.5)) + 2.506628277459239e+00) * ({p} - 0.5)
  / (((((-5.447609879822406e+01 * (({p} - 0.5) * ({p} - 0.5)) + 1.615858368580409e+02) * (({p} - 0.5) * ({p} - 0.5)) + -1.556989798598866e+02) * (({p} - 0.5) * ({p} - 0.5)) + 6.680131188771972e+01) * (({p} - 0.5) * ({p} - 0.5)) + -1.328068155288572e+01) * (({p} - 0.5) * ({p} - 0.5)) + 1)
END"""


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (used for cross-engine comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def keyed_permutation(x: Column, n: int, *key: Column, rounds: int = 4) -> Column:
    """A permutation of 0..n-1 chosen by ``key``: a Feistel network over a near-square grid, walked until inside.

    Each value of the key columns gives its own permutation, so many shuffles need no row numbering.
    The grid has fewer than sqrt(n) + 1 cells too many, so a walk of 64 steps always ends.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def step(h, k):
        left = F.pmod(h["l"] + F.pmod(F.xxhash64(k, h["r"], *key), F.lit(a)), F.lit(a))
        right = F.pmod(h["r"] + F.pmod(F.xxhash64(k, h["l"], *key), F.lit(b)), F.lit(b))
        return F.struct(F.when(k % 2 == 0, left).otherwise(h["l"]).cast("bigint").alias("l"),
                        F.when(k % 2 == 1, right).otherwise(h["r"]).cast("bigint").alias("r"))

    def once(v):
        start = F.struct(F.floor(v / F.lit(b)).cast("bigint").alias("l"), F.pmod(v, F.lit(b)).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda h: h["l"] * F.lit(b) + h["r"])

    def walk(v):
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), v, lambda w, _: F.when(w < F.lit(n), w).otherwise(once(w)))

    # all but one in sqrt(n) values are inside at once: the walk is evaluated for the others only
    first = F.transform(F.array(x.cast("bigint")), once)
    return F.transform(first, lambda v: F.when(v < F.lit(n), v).otherwise(walk(v)))[0]
