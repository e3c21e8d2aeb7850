"""Deterministic splits and folds.

Rows are assigned by an md5 hash of ``'<seed>:<key>'`` so the same rows
land in the same part on every run, every executor retry and in another
engine.  Stratified variants rank rows by that hash inside their class with
the distributed row numbering of :mod:`tabloom.functions.scan`, so a class
holding a third of the table is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.exprs import hash_hex, hash_int, hash_threshold, row_key
from tabloom.functions.scan import row_numbers
from tabloom.session import scratch_path


def _key(key_cols: list[str]):
    return F.col(key_cols[0]) if len(key_cols) == 1 else row_key(key_cols)


def hash_split(df: DataFrame, key_cols: list[str], test_pct: float = 25, seed: int = 7,
               name: str = "is_test") -> DataFrame:
    """Flag about ``test_pct`` percent of rows as test: first four hex digits below a threshold."""
    h = F.substring(hash_hex(_key(key_cols), seed), 1, 4)
    return df.withColumn(name, h < F.lit(hash_threshold(test_pct)))


def _class_rank(df: DataFrame, key_cols: list[str], label: str, seed: int) -> DataFrame:
    d = df.withColumn("_h", hash_hex(_key(key_cols), seed))
    return row_numbers(d, ["_h", *key_cols], [label], name="_rank", hashed=True)


DIGITS = 4   # leading hex digits of the hash that are counted: 65,536 parts of each class


def stratified_split(df: DataFrame, key_cols: list[str], label: str, test_pct: float = 25, seed: int = 7,
                     name: str = "is_test") -> DataFrame:
    """Exactly ``round(n_class * pct / 100)`` test rows per class, chosen by hash order.

    Counts by the hash's leading digits tell the part of each class in which its last test row lies.
    Only the rows of that part are ranked; all others are flagged by their digits, without a shuffle.
    """
    h = hash_hex(_key(key_cols), seed)
    # as a one-row generator: the hash is never copied into the filters and joins above it; a null key is first
    d = df.select("*", F.explode(F.array(F.coalesce(F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("int"), F.lit(-1)))).alias("_d"))
    counts = d.groupBy(label, "_d").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n_test = F.floor(F.sum("_n").over(Window.partitionBy(label)) * F.lit(test_pct / 100.0) + F.lit(0.5))
    last = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_n_test", n_test)
    # one row a class: the first part that reaches the number of test rows, and how many of its rows are test rows
    last = last.groupBy(label).agg(F.first("_n_test").alias("_n_test"), F.min(F.when(
        F.col("_upto") >= F.col("_n_test"), F.struct(F.col("_d").alias("d"), (F.col("_n_test") - F.col("_upto") + F.col("_n")).alias("r")))).alias("_last"))
    last = last.select(F.col(label).alias("_label"), F.coalesce("_last.d", F.lit(1 << 4 * DIGITS)).alias("_at"),
                       F.coalesce("_last.r", F.lit(0)).alias("_rest"))
    # as a small file: Spark broadcasts it by its size and joins by shuffle where classes are many
    path = scratch_path(df.sparkSession, "last-parts")
    last.coalesce(1).write.parquet(path)
    last = df.sparkSession.read.schema(last.schema).parquet(path)
    j = d.join(last, on=d[label].eqNullSafe(last["_label"]), how="inner").drop("_label")
    settled = j.where(F.col("_d") != F.col("_at")).withColumn(name, F.col("_d") < F.col("_at"))
    own = row_numbers(j.where(F.col("_d") == F.col("_at")).withColumn("_h", h), ["_h", *key_cols], [label], name="_rank")
    ranked = own.withColumn(name, F.col("_rank") <= F.col("_rest"))
    return settled.select(*df.columns, name).unionByName(ranked.select(*df.columns, name))


def train_test_split(df: DataFrame, key_cols: list[str], test_pct: float = 25, seed: int = 100,
                     stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    flagged = (stratified_split(df, key_cols, stratify, test_pct, seed) if stratify
               else hash_split(df, key_cols, test_pct, seed))
    return (flagged.where(~F.col("is_test")).drop("is_test"), flagged.where(F.col("is_test")).drop("is_test"))


def kfold(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 7, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 from the first eight hex digits of the row hash."""
    if k < 2:
        raise ValueError("k must be at least 2")
    return df.withColumn(name, F.pmod(hash_int(_key(key_cols), seed, 8), F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, key_cols: list[str], label: str, k: int = 5, seed: int = 7,
                     name: str = "fold") -> DataFrame:
    """Round-robin folds in hash order inside each class: every fold gets the class shares."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = _class_rank(df, key_cols, label, seed)
    return ranked.withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank")


def shuffle_split(df: DataFrame, key_cols: list[str], n_splits: int = 5, test_pct: float = 10,
                  seed: int = 7) -> DataFrame:
    """``n_splits`` independent hash splits (test sets may overlap): long form ``(split, ..., is_test)``."""
    base = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    seeded = F.concat(F.lit(f"{seed}-"), F.col("split").cast("string"), F.lit(":"), _key(key_cols).cast("string"))
    h = F.substring(F.md5(seeded), 1, 4)
    return base.withColumn("is_test", h < F.lit(hash_threshold(test_pct)))


def repeated_kfold(df: DataFrame, key_cols: list[str], k: int = 5, repeats: int = 3, seed: int = 7) -> DataFrame:
    """k folds drawn again per repeat (seed varies with the repeat): long form ``(repeat, ..., fold)``."""
    base = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    seeded = F.concat(F.lit(f"{seed}-"), F.col("repeat").cast("string"), F.lit(":"), _key(key_cols).cast("string"))
    h = F.conv(F.substring(F.md5(seeded), 1, 8), 16, 10).cast("bigint")
    return base.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))
