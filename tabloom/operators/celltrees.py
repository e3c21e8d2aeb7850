"""Spark's boosted trees fitted on counted cells of binned rows (M4, M5 on two classes, M10).

Spark's trees see rows only through the bins of their features (at most ``MAX_BINS``) and add up weights,
labels and squared labels per bin.  Rows of the same bins therefore always meet in the same leaf, and a fit on
one row per cell, weighted by its count, finds the trees of a fit on the rows: per (bins, class) for two
classes, per bins with the mean label for a regression target, where what varies inside a cell is the same
on both sides of every split.  There are at most ``MAX_BINS ** features * classes`` cells however many rows
there are; tables of more than ``MAX_CELLS`` are fitted on their rows.  Bins are cut at counts of all rows,
where Spark draws a sample of about 10,000.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.forest import MAX_CELLS, class_code, cut_values, feature_values

FEATURES = "features"
CELLS_A_TASK = 20_000
# bins that Spark may use for the bin numbers: so many that it looks at all cells and samples none
CELL_BINS = math.isqrt(MAX_CELLS) + 1


def with_bins(df: DataFrame, features: list[str], cuts: list[np.ndarray]) -> tuple[DataFrame, list[str]]:
    """``df`` with a bin number per feature: the number of cuts below its value."""
    own, out = [f"_x{j}" for j in range(len(features))], [f"_bin{j}" for j in range(len(features))]
    # a bucket holds its lower end, a bin its upper one
    splits = [[-math.inf, *(np.nextafter(c, np.inf).tolist() if len(c) else [0.0]), math.inf] for c in cuts]
    d = df.withColumns({x: F.col(f).cast("double") for x, f in zip(own, features)})
    d = Bucketizer(splitsArray=splits, inputCols=own, outputCols=out).transform(d)
    # bin numbers have an order: without the attributes that would make them categories
    return d.select(*df.columns, *[F.col(b).alias(b, metadata={}) for b in out]), out


class BinnedTrees:
    """A Spark model of trees over bin numbers behind ``transform``."""

    def __init__(self, trees, cuts: list[np.ndarray]):
        self.trees, self.cuts = trees, cuts
        self.featureImportances = trees.featureImportances

    def transform(self, df: DataFrame, fitted) -> DataFrame:
        binned, names = with_bins(df, fitted.features, self.cuts)
        out = self.trees.transform(VectorAssembler(inputCols=names, outputCol=FEATURES).transform(binned))
        return out.drop(*names, FEATURES, "rawPrediction")

    def cut(self, feature: int, threshold: float) -> float:
        """The value up to which a row goes left where its bin number is at most ``threshold``."""
        return float(self.cuts[feature][math.floor(threshold)])


class CellTrees:
    """Spark's boosted trees on the cells of the rows where they are few, else on the rows.

    ``make``: an estimator of two classes 0 and 1 or of a regression target under squared error.
    """

    def __init__(self, name: str, problem: str, make):
        self.name, self.problem, self.make = name, problem, make

    def fit(self, df: DataFrame, features: list[str], label: str):
        from tabloom.operators.models import Fitted, SparkMLLearner
        y = class_code(F.col(label)).alias("y")
        cuts = cut_values(df.select(feature_values(features).alias("x"), y), len(features))
        cuts = [np.unique(c[np.isfinite(c)]) for c in cuts]
        rows, bins = with_bins(df.select(*dict.fromkeys(features), y), features, cuts)
        if self.problem == "classification":
            cells = rows.groupBy(*bins, "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
        else:
            cells = rows.groupBy(*bins).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("y").alias("y"))
        cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = cells.count()
            if 0 < n <= MAX_CELLS:
                data = VectorAssembler(inputCols=bins, outputCol=FEATURES).transform(cells.coalesce(-(-n // CELLS_A_TASK)))
                est = self.make().setFeaturesCol(FEATURES).setLabelCol("y").setWeightCol("n").setPredictionCol("prediction")
                trees = est.setMaxBins(max(CELL_BINS, est.getMaxBins())).fit(data)
                return Fitted(self.name, features, label, self.problem, BinnedTrees(trees, cuts))
        finally:
            cells.unpersist()
        return SparkMLLearner(self.name, self.problem, lambda d, l: self.make()).fit(df, features, label)
