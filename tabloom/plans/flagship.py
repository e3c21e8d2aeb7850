"""The flagship flow: load, recipe, split, fit three models, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.plans.leaderboard import fit_and_rank
from tabloom.plans.recipe import Recipe
from tabloom.sources.tables import f_class

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURES = ["x1", "x2", "x3"]


def leaderboard_flow(spark: SparkSession, sf_dir: str,
                     models: tuple = ("Logistic Regression", "Decision Tree", "Gaussian NB")) -> DataFrame:
    data = f_class(spark, sf_dir)
    recipe = (Recipe(features=FEATURES, target="y").stage("impute_median", ["x1", "x2"])
              .stage("impute_mean", ["x3"]))
    fitted = recipe.fit(data)
    prepared = fitted.transform(data, project=False)
    board, _ = fit_and_rank(prepared, FEATURES, "y", "classification", KEY, list(models), "train_test", 25)
    return board.drop("fit_time")
