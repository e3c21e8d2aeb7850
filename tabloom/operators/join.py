"""Joins and column-wise concatenation.

Join strategy is left to Catalyst/AQE: a side whose runtime size is under
``spark.sql.autoBroadcastJoinThreshold`` is broadcast, anything larger is a
sort-merge join, and AQE splits skewed partitions of a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOWS = {"inner", "left", "right", "outer", "full"}


def merge(left: DataFrame, right: DataFrame, left_on: str | list[str], right_on: str | list[str] | None = None,
          how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False) -> DataFrame:
    """Equi-join keeping both key columns when their names differ.

    Clashing non-key names get ``suffixes``; a key with the same name on both
    sides appears once (coalesced for outer joins).  ``null_safe=True`` also
    matches null keys to null keys (``<=>``), as pandas does.
    """
    if how not in HOWS:
        raise ValueError(f"unsupported join type {how}")
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    l_al, r_al = left.alias("_l"), right.alias("_r")
    conds = [(F.col(f"_l.{a}").eqNullSafe(F.col(f"_r.{b}")) if null_safe else F.col(f"_l.{a}") == F.col(f"_r.{b}"))
             for a, b in zip(lk, rk)]
    j = l_al.join(r_al, on=reduce(lambda x, y: x & y, conds), how=how)
    shared_keys = {a for a, b in zip(lk, rk) if a == b}
    clash = (set(left.columns) & set(right.columns)) - shared_keys
    out = []
    for c in left.columns:
        if c in shared_keys:
            if how in ("right",):
                out.append(F.col(f"_r.{c}").alias(c))
            elif how in ("outer", "full"):
                out.append(F.coalesce(F.col(f"_l.{c}"), F.col(f"_r.{c}")).alias(c))
            else:
                out.append(F.col(f"_l.{c}").alias(c))
        else:
            out.append(F.col(f"_l.{c}").alias(c + suffixes[0] if c in clash else c))
    for c in right.columns:
        if c in shared_keys:
            continue
        out.append(F.col(f"_r.{c}").alias(c + suffixes[1] if c in clash else c))
    return j.select(*out)


def concat_columns(df: DataFrame, new_cols: dict) -> DataFrame:
    """Add derived columns beside the source ones (never a positional join)."""
    return df.withColumns(new_cols)


def append_rows(base: DataFrame, more: DataFrame) -> DataFrame:
    """Append rows by column name (registry tables: recipes, model lists, leaderboards)."""
    return base.unionByName(more, allowMissingColumns=True)
