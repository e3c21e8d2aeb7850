"""Projections, casts and cleaning (C1-C11).  All are single-pass column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import INTEGRAL_TYPES, is_numeric, strip_symbols


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the columns that exist (replaying on a table without them is a no-op)."""
    return df.drop(*[c for c in cols if c in df.columns])


def _text_to_null(c):
    t = F.trim(c.cast("string"))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def int_expr(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if isinstance(dt, INTEGRAL_TYPES):
        return F.col(c).cast("bigint")
    if is_numeric(dt):
        return F.col(c).try_cast("bigint")
    return _text_to_null(F.col(c)).try_cast("bigint")


def float_expr(df: DataFrame, c: str, with_quote: bool = True):
    dt = df.schema[c].dataType
    if is_numeric(dt):
        return F.col(c).cast("double")
    stripped = strip_symbols(F.col(c).cast("string"), with_quote)
    return F.when(stripped == "", F.lit(None).cast("double")).otherwise(stripped.try_cast("double"))


def _apply(df: DataFrame, exprs: dict, suffix: str | None) -> DataFrame:
    if suffix:
        return df.withColumns({f"{c}{suffix}": e for c, e in exprs.items()})
    return df.withColumns(exprs)


def to_int(df: DataFrame, cols: list[str], suffix: str | None = "_int") -> DataFrame:
    """Text or number to bigint; empty text and failed casts become null."""
    return _apply(df, {c: int_expr(df, c) for c in cols}, suffix)


def to_float(df: DataFrame, cols: list[str], suffix: str | None = "_float") -> DataFrame:
    """Strip `` ?,!/;:$'`` then cast to double; empty text becomes null."""
    return _apply(df, {c: float_expr(df, c, True) for c in cols}, suffix)


def to_string(df: DataFrame, cols: list[str], suffix: str | None = "_string") -> DataFrame:
    return _apply(df, {c: F.col(c).cast("string") for c in cols}, suffix)


def remove_symbols(df: DataFrame, cols: list[str], suffix: str | None = None) -> DataFrame:
    """Strip `` ?,!/;:$`` then cast to double (in place by default)."""
    return _apply(df, {c: float_expr(df, c, False) for c in cols}, suffix)


def to_datetime(df: DataFrame, cols: list[str], fmt: str | None = None, suffix: str | None = None) -> DataFrame:
    """Text to timestamp (no time zone); unparsable text becomes null."""
    exprs = {}
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            exprs[c] = F.col(c).cast("timestamp_ntz")
        elif isinstance(dt, T.DateType):
            exprs[c] = F.col(c).cast("timestamp_ntz")
        else:
            parsed = F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)) if fmt else \
                F.try_to_timestamp(F.col(c).cast("string"))
            exprs[c] = parsed.cast("timestamp_ntz")
    return _apply(df, exprs, suffix)


def _int_type_for(lo, hi):
    for name, bound in (("tinyint", 2 ** 7), ("smallint", 2 ** 15), ("int", 2 ** 31)):
        if lo >= -bound and hi <= bound - 1:
            return name
    return "bigint"


def downcast_numeric(df: DataFrame, floats: bool = False) -> DataFrame:
    """Narrow integer columns to the smallest type holding their range (one min/max pass).

    ``floats=True`` also narrows double to float (loses digits; off by default).
    """
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL_TYPES)]
    if not ints and not floats:
        return df
    aggs = []
    for c in ints:
        aggs += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi")]
    r = df.agg(*aggs).collect()[0] if aggs else None
    out = []
    for f in df.schema.fields:
        if f.name in ints and r[f"{f.name}__lo"] is not None:
            out.append(F.col(f.name).cast(_int_type_for(r[f"{f.name}__lo"], r[f"{f.name}__hi"])).alias(f.name))
        elif floats and isinstance(f.dataType, T.DoubleType):
            out.append(F.col(f.name).cast("float").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=subset)


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls (and NaN) per column, one pass."""
    aggs = []
    for c in cols:
        dt = df.schema[c].dataType
        isnull = F.col(c).isNull()
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            isnull = isnull | F.isnan(F.col(c))
        aggs.append(F.count_if(isnull).alias(c))
    r = df.agg(*aggs)
    return r.select(F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c))]).alias("column", "nulls"))


def null_guard(df: DataFrame, cols: list[str]) -> None:
    """Refuse (raise) when any chosen column holds a null, as log/sqrt/Box-Cox do."""
    bad = [r["column"] for r in null_counts(df, cols).collect() if r["nulls"] > 0]
    if bad:
        raise ValueError(f"columns contain nulls, impute them first: {bad}")


def add_suffix(df: DataFrame, cols: list[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in cols})


def preview(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows; pass ``order_by`` for a defined order (top-n sort, no full sort)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
