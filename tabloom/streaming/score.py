"""Scoring new rows as they arrive.

A fitted recipe is a chain of column projections and a Spark ML pipeline
model is a row-wise transform, so both apply unchanged to a streaming
DataFrame: new files in a folder are cleaned, encoded and scored
incrementally, with exactly-once output through the checkpoint folder.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.models import Fitted
from tabloom.plans.recipe import Recipe


def scored_stream(stream: DataFrame, recipe: Recipe | None, fitted: Fitted, keep: list[str]) -> DataFrame:
    """Replay ``recipe`` and apply ``fitted`` to a streaming DataFrame (row-wise models only)."""
    if not isinstance(fitted.model, PipelineModel):
        raise TypeError(f"{fitted.name} needs joins or aggregations; score it in foreachBatch instead")
    cur = recipe.transform(stream, project=False) if recipe is not None else stream
    out = fitted.transform(cur)
    cols = [F.col(c) for c in keep] + [F.col("prediction").alias("Predictions")]
    if "probability" in out.columns:
        cols.append(F.array_max(vector_to_array("probability")).alias("Probability"))
    return out.select(*cols)


def replay_folder(spark: SparkSession, source: str, schema: T.StructType, recipe: Recipe, sink: str,
                  checkpoint: str, fmt: str = "parquet"):
    """Replay a fitted recipe over every file in ``source`` not yet processed, appending to ``sink``."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    out = recipe.transform(stream)
    query = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def score_folder(spark: SparkSession, source: str, schema: T.StructType, recipe: Recipe | None, fitted: Fitted,
                 keep: list[str], sink: str, checkpoint: str, fmt: str = "parquet"):
    """Score every file present in ``source`` (and not yet scored) into ``sink``; returns the finished query."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    out = scored_stream(stream, recipe, fitted, keep)
    query = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def score_batches(spark: SparkSession, source: str, schema: T.StructType, fitted: Fitted, keep: list[str],
                  sink: str, checkpoint: str, recipe: Recipe | None = None, fmt: str = "parquet"):
    """Like :func:`score_folder` for any model (kNN, AdaBoost ...): each micro-batch is scored as a batch."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)

    def handle(batch: DataFrame, epoch: int) -> None:
        cur = recipe.transform(batch, project=False) if recipe is not None else batch
        out = fitted.transform(cur)
        cols = [F.col(c) for c in keep] + [F.col("prediction").alias("Predictions")]
        # one folder per epoch, overwritten on a retry: replays never duplicate rows
        out.select(*cols).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
