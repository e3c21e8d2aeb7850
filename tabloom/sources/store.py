"""Model and leaderboard stores.

Models are written with Spark ML persistence (custom learners as a folder
of Spark ML stages plus a JSON description); every saved model has its own
registry entry, so saving a model replaces only the entry of that name.
"""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tabloom.operators.boosting import BoostedPayload, Forest
from tabloom.operators.forest import ForestPayload
from tabloom.operators.models import Fitted, _AdaPayload, _DecodedPayload, _OvRPayload


def _write_json(spark: SparkSession, path: str, obj: dict) -> None:
    spark.createDataFrame([(json.dumps(obj),)], "v string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_model(spark: SparkSession, fitted: Fitted, path: str, fit_time: float | None = None,
               registry: str | None = None) -> None:
    from tabloom.operators.knn import _KNNPayload
    meta = {"name": fitted.name, "features": fitted.features, "label": fitted.label, "problem": fitted.problem,
            "classes": fitted.classes, "fit_time": fit_time}
    m = fitted.model
    if isinstance(m, PipelineModel):
        meta["kind"] = "pipeline"
        m.write().overwrite().save(f"{path}/model")
    elif isinstance(m, _OvRPayload):
        meta["kind"] = "ovr"
        meta["ovr_classes"] = sorted(m.models)
        for i, c in enumerate(sorted(m.models)):
            m.models[c].write().overwrite().save(f"{path}/class_{i}")
    elif isinstance(m, _AdaPayload):
        meta["kind"] = "adaboost"
        meta["alphas"] = m.alphas
        meta["n_stages"] = len(m.stages)
        for i, s in enumerate(m.stages):
            s.write().overwrite().save(f"{path}/stage_{i}")
    elif isinstance(m, _KNNPayload):
        lr = m.learner
        meta.update({"kind": "knn", "key": m.key, "k": lr.k, "metric": lr.metric, "weights": lr.weights,
                     "p": lr.p, "key_cols": lr.key_cols})
        m.train.write.mode("overwrite").parquet(f"{path}/train")
    elif isinstance(m, BoostedPayload):
        # JSON numbers keep every bit of a double
        meta.update({"kind": "boosted", "forest": m.forest.to_json(), "boosted_classes": m.classes})
    elif isinstance(m, ForestPayload):
        meta.update({"kind": "forest", "forest": m.to_json()})
    elif isinstance(m, _DecodedPayload):
        meta.update({"kind": "labels", "type": m.type_name, "classes": [str(v) for v in m.labels]})
        save_model(spark, m.inner, f"{path}/inner")
    else:
        raise TypeError(f"cannot save {type(m).__name__}")
    _write_json(spark, f"{path}/meta", meta)
    if registry:
        _write_json(spark, f"{registry}/{fitted.name}", {"model_name": fitted.name, "kind": meta["kind"],
                                                        "path": path, "fit_time": fit_time,
                                                        "saved_at": time.time()})


def load_model(spark: SparkSession, path: str) -> Fitted:
    from tabloom.operators.knn import KNNLearner, _KNNPayload
    meta = _read_json(spark, f"{path}/meta")
    f = Fitted(meta["name"], meta["features"], meta["label"], meta["problem"], None, meta.get("classes") or [])
    kind = meta["kind"]
    if kind == "pipeline":
        f.model = PipelineModel.load(f"{path}/model")
    elif kind == "ovr":
        f.model = _OvRPayload({c: PipelineModel.load(f"{path}/class_{i}") for i, c in enumerate(meta["ovr_classes"])})
    elif kind == "adaboost":
        cls = DecisionTreeClassificationModel if meta["problem"] == "classification" else DecisionTreeRegressionModel
        stages = [cls.load(f"{path}/stage_{i}") for i in range(meta["n_stages"])]
        f.model = _AdaPayload(stages, meta["alphas"], f.classes, meta["problem"])
    elif kind == "boosted":
        f.model = BoostedPayload(Forest.from_json(meta["forest"]), meta["problem"], meta["boosted_classes"])
    elif kind == "forest":
        f.model = ForestPayload.from_json(meta["forest"])
    elif kind == "labels":
        # labels are stored as text and cast back by Spark
        row = spark.range(1).select(*[F.lit(v).cast(meta["type"]).alias(f"c{i}")
                                      for i, v in enumerate(meta["classes"])]).first()
        f.classes = list(row)
        f.model = _DecodedPayload(load_model(spark, f"{path}/inner"), f.classes, meta["type"])
    elif kind == "knn":
        lr = KNNLearner(meta["problem"], meta["k"], meta["metric"], meta["weights"], meta["p"], meta["key_cols"])
        f.model = _KNNPayload(spark.read.parquet(f"{path}/train"), meta["key"], f.classes, lr)
    return f


def list_models(spark: SparkSession, registry: str) -> DataFrame:
    schema = "model_name string, kind string, path string, fit_time double, saved_at double"
    try:
        raw = spark.read.text(f"{registry}/*")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return raw.select(F.from_json("value", schema).alias("m")).select("m.*")


CLASS_BOARD = "model string, accuracy double, roc_auc double, precision_weighted double, recall_weighted double, " \
              "f1_weighted double, fit_time double"
REG_BOARD = "model string, mae double, mse double, rmse double, r2 double, explained_variance double, fit_time double"


def save_leaderboard(board: DataFrame, path: str) -> None:
    board.coalesce(1).write.mode("overwrite").parquet(path)


def load_leaderboard(spark: SparkSession, path: str, problem: str = "classification") -> DataFrame:
    """The stored leaderboard, or an empty one with the problem type's columns."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CLASS_BOARD if problem == "classification" else REG_BOARD)
