"""Model fitting and scoring.

Learners share one small interface: ``fit(df, features, label) -> Fitted``,
and ``Fitted.transform(df)`` adds ``prediction`` (double) and, for
classifiers, ``probability`` (vector).  Spark ML estimators cover most of
the registry; AdaBoost is a loop of Spark ML fits (one distributed job per round, lineage cut
by reliable checkpoints), boosting with leaf penalties or more than two classes is
:mod:`tabloom.operators.boosting`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, NaiveBayes, OneVsRest)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage, spread

FEATURES = "features"


def assemble(df: DataFrame, features: list[str], out: str = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


@dataclass
class Fitted:
    name: str
    features: list[str]
    label: str
    problem: str
    model: object = None            # PipelineModel or custom payload
    classes: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        if isinstance(self.model, PipelineModel):
            out = self.model.transform(df)
            drop = [c for c in (FEATURES, "rawPrediction") if c in out.columns]
            return out.drop(*drop)
        return self.model.transform(df, self)

    @property
    def last_stage(self):
        return self.model.stages[-1] if isinstance(self.model, PipelineModel) else self.model


class SparkMLLearner:
    """A Spark ML estimator behind a vector assembler.

    ``iterates``: the fit passes over its rows many times and adds up per task, so they are dealt over all cores first.
    """

    def __init__(self, name: str, problem: str, make, iterates: bool = False):
        self.name, self.problem, self.make, self.iterates = name, problem, make, iterates

    def fit(self, df: DataFrame, features: list[str], label: str) -> Fitted:
        if self.iterates:
            df = spread(df.select(*dict.fromkeys([*features, label])), df.count()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(df, features, label)
        finally:
            if self.iterates:
                df.unpersist()

    def _fit(self, df: DataFrame, features: list[str], label: str) -> Fitted:
        est = self.make(df, label)
        est.setFeaturesCol(FEATURES).setLabelCol(label)
        if hasattr(est, "setPredictionCol"):
            est.setPredictionCol("prediction")
        pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol=FEATURES), est])
        return Fitted(self.name, features, label, self.problem, pipe.fit(df))


# ---------------------------------------------------------------- labels

MAX_CLASSES = 10_000   # distinct labels a classifier is fitted for; more is a regression target


def class_labels(df: DataFrame, label: str) -> list:
    """The sorted distinct non-null labels; refuses a column with more than ``MAX_CLASSES``."""
    got = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(got) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} distinct values: not a class label")
    return sorted(got)


def _are_indices(labels: list) -> bool:
    return all(not isinstance(v, (str, bool)) and v == i for i, v in enumerate(labels))


class _DecodedPayload:
    """A model of class indices behind the original labels: ``prediction`` is a label again."""

    def __init__(self, inner: Fitted, labels: list, type_name: str):
        self.inner, self.labels, self.type_name = inner, labels, type_name

    def transform(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        names = F.array(*[F.lit(v).cast(self.type_name) for v in self.labels])
        out = self.inner.transform(df)
        return out.withColumn("prediction", F.get(names, F.col("prediction").cast("int")))


class AnyLabel:
    """A classifier for any label type.

    Labels other than 0..k-1 are numbered in sorted order for the fit, and
    predictions are turned back; probabilities stay in sorted label order.
    """

    def __init__(self, inner):
        self.__dict__["inner"] = inner

    def __getattr__(self, name):
        return getattr(self.__dict__["inner"], name)

    def __setattr__(self, name, value):
        setattr(self.inner, name, value)

    def fit(self, df: DataFrame, features: list[str], label: str) -> Fitted:
        labels = class_labels(df, label)
        if _are_indices(labels):
            fitted = self.inner.fit(df, features, label)
            fitted.classes = fitted.classes or labels
            return fitted
        kind = df.schema[label].dataType.simpleString()
        index = F.array_position(F.array(*[F.lit(v).cast(kind) for v in labels]), F.col(label)) - 1
        coded = df.where(F.col(label).isNotNull()).withColumn("_class", index.cast("double"))
        inner = self.inner.fit(coded, features, "_class")
        return Fitted(self.inner.name, features, label, "classification", _DecodedPayload(inner, labels, kind), labels)


# ---------------------------------------------------------------- custom learners

class _OvRPayload:
    """One binary probabilistic model per class; probabilities normalised to sum to one."""

    def __init__(self, models: dict):
        self.models = models  # class -> PipelineModel producing 'probability'

    def transform(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        classes = sorted(self.models)
        out = df
        for i, c in enumerate(classes):
            scored = self.models[c].transform(out)
            out = scored.withColumn(f"_p{i}", vector_to_array("probability")[1]).drop(
                "probability", "rawPrediction", "prediction", FEATURES)
        own = [F.col(f"_p{i}") for i in range(len(classes))]
        total = sum(own, F.lit(0.0))
        probs = F.array(*[p / total for p in own])
        best = F.array_position(probs, F.array_max(probs)) - 1
        cls_arr = F.array(*[F.lit(float(c)) for c in classes])
        out = out.withColumn("probability", array_to_vector(probs)) \
                 .withColumn("prediction", F.element_at(cls_arr, (best + 1).cast("int")))
        return out.drop(*[f"_p{i}" for i in range(len(classes))])


class OneVsRestBoosted:
    """Multiclass gradient boosting: one binary GBT per class (Spark's GBT is binary only)."""

    def __init__(self, name: str, make_binary):
        self.name, self.problem, self.make_binary = name, "classification", make_binary

    def fit(self, df: DataFrame, features: list[str], label: str) -> Fitted:
        classes = class_labels(df, label)
        if len(classes) <= 2:
            return SparkMLLearner(self.name, "classification", lambda d, l: self.make_binary()).fit(df, features, label)
        models = {}
        for c in classes:
            binary = df.withColumn("_bin", (F.col(label) == F.lit(c)).cast("double"))
            est = self.make_binary().setFeaturesCol(FEATURES).setLabelCol("_bin")
            pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol=FEATURES), est])
            models[c] = pipe.fit(binary)
        return Fitted(self.name, features, label, "classification", _OvRPayload(models), classes)


class GradientBoosting:
    """Gradient boosting: Spark's GBT (on counted cells) on two classes, one softmax model of K trees a round on more."""

    def __init__(self, name: str, make_binary, params):
        self.name, self.problem, self.make_binary, self.params = name, "classification", make_binary, params

    def fit(self, df: DataFrame, features: list[str], label: str) -> Fitted:
        from tabloom.operators.boosting import Boosted
        from tabloom.operators.celltrees import CellTrees
        if len(class_labels(df, label)) <= 2:
            return CellTrees(self.name, "classification", self.make_binary).fit(df, features, label)
        return Boosted(self.name, "classification", self.params).fit(df, features, label)


class _AdaPayload:
    def __init__(self, stages, alphas, classes, problem):
        self.stages, self.alphas, self.classes, self.problem = stages, alphas, classes, problem

    def transform(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        out = assemble(df, fitted.features)
        for i, m in enumerate(self.stages):
            out = m.setPredictionCol(f"_m{i}").transform(out)
            for c in ("rawPrediction", "probability", "variance"):
                if c in out.columns:
                    out = out.drop(c)
        if self.problem == "classification":
            # SAMME vote: class with the largest sum of alphas
            scores = [sum((F.when(F.col(f"_m{i}") == F.lit(float(c)), F.lit(a)).otherwise(F.lit(0.0))
                           for i, a in enumerate(self.alphas)), F.lit(0.0)) for c in self.classes]
            arr = F.array(*scores)
            tot = sum(self.alphas) or 1.0
            best = F.array_position(arr, F.array_max(arr))
            cls = F.array(*[F.lit(float(c)) for c in self.classes])
            out = out.withColumn("prediction", F.element_at(cls, best.cast("int"))) \
                     .withColumn("probability", array_to_vector(F.transform(arr, lambda s: s / F.lit(tot))))
        else:
            # weighted median of the rounds' predictions
            pairs = F.array_sort(F.arrays_zip(F.array(*[F.col(f"_m{i}") for i in range(len(self.stages))]).alias("p"),
                                              F.array(*[F.lit(a) for a in self.alphas]).alias("w")))
            half = sum(self.alphas) / 2.0
            cum = F.transform(pairs, lambda x, i: F.aggregate(F.slice(pairs, 1, i + 1), F.lit(0.0),
                                                              lambda acc, y: acc + y["w"]))
            idx = F.array_position(F.transform(cum, lambda c: c >= F.lit(half)), True)
            out = out.withColumn("prediction", F.element_at(pairs, idx.cast("int"))["p"])
        return out.drop(FEATURES, *[f"_m{i}" for i in range(len(self.stages))])


class AdaBoost:
    """AdaBoost: SAMME (classification, depth-1 trees) or AdaBoost.R2 (regression, depth-3 trees).

    Each round fits a weighted tree (``weightCol``) and updates the weights
    with one projection plus one aggregate; the weighted table is
    checkpointed to the shared folder every few rounds to keep plans short.
    """

    def __init__(self, problem: str, n_estimators: int = 50, learning_rate: float = 1.0,
                 max_depth: int | None = None, checkpoint_every: int = 5):
        self.name = "AdaBoost"
        self.problem, self.n, self.lr = problem, n_estimators, learning_rate
        self.depth = max_depth or (1 if problem == "classification" else 3)
        self.every = checkpoint_every

    def fit(self, df: DataFrame, features: list[str], label: str) -> Fitted:
        data = assemble(spread(df.select(*features, F.col(label).cast("double").alias("_y"))), features).select(FEATURES, "_y")
        data = cut_lineage(data.withColumn("_w", F.lit(1.0)))   # every round reads it
        # a regression target has no classes: its values are never listed
        classes = class_labels(data, "_y") if self.problem == "classification" else []
        k = len(classes)
        # the fits of all rounds know the classes and need not look for them
        known = {"ml_attr": {"type": "nominal", "name": "_y", "vals": [str(c) for c in classes]}} if classes and _are_indices(classes) else {}
        data = data.withColumn("_y", F.col("_y").alias("_y", metadata=known))
        cur = data.persist(StorageLevel.MEMORY_AND_DISK)
        stages, alphas = [], []
        for t in range(self.n):
            if self.problem == "classification":
                est = DecisionTreeClassifier(maxDepth=self.depth, featuresCol=FEATURES, labelCol="_y",
                                             weightCol="_w", predictionCol="_p")
            else:
                est = DecisionTreeRegressor(maxDepth=self.depth, featuresCol=FEATURES, labelCol="_y",
                                            weightCol="_w", predictionCol="_p")
            m = est.fit(cur)
            scored = m.transform(cur).select(FEATURES, "_y", "_w", "_p")
            if self.problem == "classification":
                # one aggregate per round: weighted error and total weight
                miss = (F.col("_p") != F.col("_y")).cast("double")
                r = scored.agg(F.sum(F.col("_w") * miss).alias("e"), F.sum("_w").alias("t")).collect()[0]
                err = r["e"] / r["t"]
                if err <= 0:
                    stages.append(m)
                    alphas.append(1.0)
                    break
                if err >= 1 - 1.0 / k:
                    break
                alpha = self.lr * (math.log((1 - err) / err) + math.log(k - 1))
                new_w = F.col("_w") / F.lit(r["t"]) * F.exp(F.lit(alpha) * miss)
            else:
                absdiff = F.abs(F.col("_p") - F.col("_y"))
                mx = scored.agg(F.max(absdiff)).collect()[0][0]
                if not mx:
                    stages.append(m)
                    alphas.append(1.0)
                    break
                loss = absdiff / F.lit(mx)
                r = scored.agg(F.sum(F.col("_w") * loss).alias("l"), F.sum("_w").alias("t")).collect()[0]
                avg_loss = r["l"] / r["t"]
                if avg_loss >= 0.5:
                    if not stages:
                        stages.append(m)
                        alphas.append(1.0)
                    break
                beta = avg_loss / (1 - avg_loss)
                alpha = self.lr * math.log(1 / beta)
                new_w = F.col("_w") / F.lit(r["t"]) * F.pow(F.lit(beta), (1 - loss) * F.lit(self.lr))
            stages.append(m)
            alphas.append(alpha)
            # a round reads its weights several times: they are held, and the round before is let go
            before, cur = cur, scored.withColumn("_w", new_w).drop("_p").persist(StorageLevel.MEMORY_AND_DISK)
            if (t + 1) % self.every == 0:
                held = cur
                cur = cut_lineage(held).persist(StorageLevel.MEMORY_AND_DISK)
                held.unpersist()
            else:
                cur.count()
            before.unpersist()
        cur.unpersist()
        return Fitted(self.name, features, label, self.problem, _AdaPayload(stages, alphas, classes, self.problem),
                      classes)


# ---------------------------------------------------------------- registry

def _logreg(df, label):
    n = df.count()
    # scikit-learn's defaults: C = 1 (L2), 100 iterations, tolerance 1e-4
    return LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-4)


def _gbt_cls():
    return GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=7)


def gradient_boosting(rounds: int = 100, learning_rate: float = 0.1, max_depth: int = 3):
    """Parameters of plain gradient boosting on softmax: no leaf penalty, Newton leaves."""
    from tabloom.operators.boosting import Boost
    return Boost(rounds=rounds, learning_rate=learning_rate, max_depth=max_depth, l2=0.0, min_child_weight=0.0, softmax_factor=None)


def classification_learners() -> dict:
    from tabloom.operators.boosting import Boosted
    from tabloom.operators.forest import RandomForest
    from tabloom.operators.kernel import KernelMachine
    from tabloom.operators.knn import KNNLearner
    found = {
        "Logistic Regression": SparkMLLearner("Logistic Regression", "classification", _logreg, iterates=True),
        "Random Forest": RandomForest(),
        "Decision Tree": SparkMLLearner("Decision Tree", "classification",
                                        lambda d, l: DecisionTreeClassifier(maxDepth=30, seed=7)),
        "KNN": KNNLearner("classification"),
        "AdaBoost": AdaBoost("classification"),
        "Gradient Boosting": GradientBoosting("Gradient Boosting", _gbt_cls, gradient_boosting()),
        "Gaussian NB": SparkMLLearner("Gaussian NB", "classification",
                                      lambda d, l: NaiveBayes(modelType="gaussian")),
        "XGB": Boosted("XGB", "classification"),
        "Linear SVC": SparkMLLearner("Linear SVC", "classification", _svc, iterates=True),
        "SVC": KernelMachine("classification"),
    }
    return {name: AnyLabel(learner) for name, learner in found.items()}


def _svc(df, label):
    n_classes = len(class_labels(df, label))
    svc = LinearSVC(regParam=1.0 / max(1, df.count()), maxIter=100)     # C = 1
    return OneVsRest(classifier=svc) if n_classes > 2 else svc


def regression_learners() -> dict:
    from tabloom.operators.boosting import Boosted
    from tabloom.operators.celltrees import CellTrees
    from tabloom.operators.kernel import KernelMachine
    from tabloom.operators.knn import KNNLearner
    return {
        "Linear Regression": SparkMLLearner("Linear Regression", "regression",
                                            lambda d, l: LinearRegression(solver="normal")),
        "Random Forest": SparkMLLearner("Random Forest", "regression",
                                        lambda d, l: RandomForestRegressor(numTrees=100, maxDepth=30, seed=7)),
        "Decision Tree": SparkMLLearner("Decision Tree", "regression",
                                        lambda d, l: DecisionTreeRegressor(maxDepth=30, seed=7)),
        "KNN": KNNLearner("regression"),
        "AdaBoost": AdaBoost("regression"),
        "Gradient Boosting": CellTrees("Gradient Boosting", "regression",
                                       lambda: GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, seed=7)),
        "XGB": Boosted("XGB", "regression"),
        "SVR": KernelMachine("regression"),
    }


def learners(problem: str) -> dict:
    return classification_learners() if problem == "classification" else regression_learners()


# ---------------------------------------------------------------- scoring

def predict(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Add ``Predictions`` and, for classifiers with probabilities, ``Probability`` (top class share)."""
    out = fitted.transform(df)
    if "probability" in out.columns:
        # column names are case-insensitive: build under a temporary name first
        out = out.withColumn("_top_p", F.array_max(vector_to_array("probability"))).drop("probability")
        out = out.withColumnRenamed("_top_p", "Probability")
    return out.withColumnRenamed("prediction", "Predictions")


def prediction_histogram(pred: DataFrame, problem: str, nbins: int = 10) -> DataFrame:
    from tabloom.operators.profile import count_values, histogram
    if problem == "classification":
        return count_values(pred, "Predictions")
    return histogram(pred, "Predictions", nbins)
