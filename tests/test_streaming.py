"""A fitted recipe and model score a folder of new files as a stream."""
import os

from pyspark.sql import functions as F

from tabloom.operators.models import learners
from tabloom.plans.recipe import Recipe
from tabloom.session import scratch_path
from tabloom.sources.tables import f_class
from tabloom.streaming.score import score_batches, score_folder

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def test_stream_scoring_matches_batch(spark, sf):
    d = f_class(spark, sf)
    recipe = Recipe().stage("impute_mean", ["x3"]).fit(d)
    fitted = learners("classification")["Logistic Regression"].fit(recipe.transform(d, project=False),
                                                                    ["x1", "x2", "x3"], "y")
    src = scratch_path(spark, "src")
    d.repartition(3).write.parquet(src)
    sink, ck = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    score_folder(spark, src, d.schema, recipe, fitted, KEY, sink, ck)
    streamed = spark.read.parquet(sink)
    batch = fitted.transform(recipe.transform(d, project=False)).select(*KEY, F.col("prediction").alias("Predictions"))
    assert streamed.count() == d.count()
    assert streamed.select(*KEY, "Predictions").exceptAll(batch).count() == 0

    sink2, ck2 = scratch_path(spark, "sink"), scratch_path(spark, "ck")
    score_batches(spark, src, d.schema, fitted, KEY, sink2, ck2, recipe)
    assert spark.read.parquet(sink2).count() == d.count()
    assert os.path.isdir(ck2)
