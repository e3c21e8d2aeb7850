"""Fit-and-rank (M11) and cross-validation (Q13).

Each model is one or more distributed fits; the train and test parts are
persisted once and shared by every model of the leaderboard.  Only metric
values reach the driver.
"""

from __future__ import annotations

import time

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import StorageLevel

from tabloom.operators import evaluate as E
from tabloom.operators.models import class_labels, learners
from tabloom.operators.split import hash_split, kfold, shuffle_split, stratified_kfold, stratified_split

CLASS_METRICS = ["accuracy", "roc_auc", "precision_weighted", "recall_weighted", "f1_weighted"]
REG_METRICS = ["mae", "mse", "rmse", "r2", "explained_variance"]


def score(pred: DataFrame, label: str, problem: str, average_over: str = "predicted",
          proba_auc: bool = False, classes: list | None = None) -> dict:
    """Metrics of one scored table: classification (Q1/Q3/Q4) or regression (Q2).

    ``classes``: the fitted model's labels, in the order of its probabilities.
    """
    if problem == "regression":
        r = E.regression_metrics(pred, label, "prediction").collect()[0]
        return {k: float(r[k]) if r[k] is not None else None for k in REG_METRICS}
    if proba_auc and "probability" in pred.columns:
        # one run of the model for all metrics: label, prediction and probabilities only
        pred = pred.select(label, "prediction", vector_to_array("probability").alias("_pa")) \
            .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        r = E.classification_metrics(pred, label, "prediction", average_over).collect()[0].asDict()
        if "_pa" in pred.columns:
            classes = classes or class_labels(pred, label)
            if len(classes) <= 2:
                r["roc_auc"] = E.roc_auc(pred.withColumn("_s", F.get("_pa", len(classes) - 1)), label, "_s", classes[-1])
            else:
                r["roc_auc"] = E.roc_auc_ovr_weighted(
                    pred.select(label, *[F.get("_pa", i).alias(f"_s{i}") for i in range(len(classes))]), label,
                    {c: f"_s{i}" for i, c in enumerate(classes)})
    finally:
        pred.unpersist()
    return {k: r.get(k) for k in CLASS_METRICS}


def validation_folds(df: DataFrame, label: str, problem: str, key_cols: list[str], k: int = 5,
                     kind: str = "kfold", seed: int = 7) -> DataFrame:
    """``df`` with what :func:`fold_parts` needs: ``kfold`` or, by problem, ``stratified_kfold`` / ``shuffle_split``."""
    allowed = ["kfold", "stratified_kfold" if problem == "classification" else "shuffle_split"]
    if kind not in allowed:
        raise ValueError(f"unknown validation {kind!r} for {problem}: one of {allowed}")
    if kind == "stratified_kfold":
        return stratified_kfold(df, key_cols, label, k, seed)
    if kind == "shuffle_split":
        return shuffle_split(df, key_cols, k, 10, seed)
    return kfold(df, key_cols, k, seed)


def fold_parts(folded: DataFrame, f: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of fold or split ``f``."""
    if "is_test" in folded.columns and "split" in folded.columns:
        own = folded.where(F.col("split") == f).drop("split")
        return own.where(~F.col("is_test")).drop("is_test"), own.where(F.col("is_test")).drop("is_test")
    return folded.where(F.col("fold") != f).drop("fold"), folded.where(F.col("fold") == f).drop("fold")


def needed(df: DataFrame, features: list[str], label: str, used: list) -> list[str]:
    """The columns of ``df`` that fits and scores read: all of them where a learner pairs rows by a key."""
    if any(hasattr(learner, "key_cols") for learner in used):
        return df.columns
    return [c for c in df.columns if c in {*features, label}]


def cross_validate(learner, df: DataFrame, features: list[str], label: str, problem: str, key_cols: list[str],
                   k: int = 5, kind: str = "kfold", seed: int = 7) -> list[dict]:
    """Per-fold scores (fold = test part, the rest = train); ``kind`` as in :func:`validation_folds`."""
    folded = validation_folds(df, label, problem, key_cols, k, kind, seed)
    marks = [c for c in folded.columns if c not in df.columns or c in ("fold", "split", "is_test")]
    folded = folded.select(*dict.fromkeys([*needed(df, features, label, [learner]), *marks])).persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    try:
        for f in range(k):
            train, test = fold_parts(folded, f)
            fitted = learner.fit(train, features, label)
            m = score(fitted.transform(test), label, problem, average_over="all", proba_auc=True,
                      classes=fitted.classes or None)
            m["fold"] = f
            out.append(m)
    finally:
        folded.unpersist()
    return out


def fit_and_rank(df: DataFrame, features: list[str], label: str, problem: str, key_cols: list[str],
                 models: list[str] | None = None, validation: str = "train_test", test_pct: float = 25,
                 folds: int = 5, seed: int = 100, resample: str | None = None,
                 decimals: int = 4) -> tuple[DataFrame, dict]:
    """Fit each model, score it, and rank: F1 descending (classification) or RMSE ascending.

    ``validation='train_test'`` keeps the fit on the train part; a CV
    validation averages fold scores and then refits on all rows.
    """
    spark = df.sparkSession
    registry = learners(problem)
    names = models or list(registry)
    fitted_models, rows = {}, []
    metric_names = CLASS_METRICS if problem == "classification" else REG_METRICS
    if validation == "train_test":
        if problem == "classification":
            flagged = stratified_split(df, key_cols, label, test_pct, seed)
        else:
            flagged = hash_split(df, key_cols, test_pct, seed)
        # the split is made once; both parts read it
        keep = df.columns if resample else needed(df, features, label, [registry[name] for name in names])
        flagged = flagged.select(*dict.fromkeys([*keep, "is_test"])).persist(StorageLevel.MEMORY_AND_DISK)
        train = flagged.where(~F.col("is_test")).drop("is_test")
        test = flagged.where(F.col("is_test")).drop("is_test")
        if resample and problem == "classification":
            from tabloom.operators.resample import smote, smoteenn
            train = (smote if resample == "SMOTE" else smoteenn)(train, features, label, key_cols)
            key_cols = key_cols + ["synthetic_id"]
            train = train.persist(StorageLevel.MEMORY_AND_DISK)
            test = test.withColumn("synthetic_id", F.lit(0).cast("bigint"))
    try:
        for name in names:
            learner = registry[name]
            if hasattr(learner, "key_cols") and learner.key_cols is None:
                learner.key_cols = key_cols
            t0 = time.time()
            if validation == "train_test":
                fitted = learner.fit(train, features, label)
                m = score(fitted.transform(test), label, problem)
            else:
                per_fold = cross_validate(learner, df, features, label, problem, key_cols, folds, validation)
                m = {k: _mean([f[k] for f in per_fold]) for k in metric_names}
                if problem == "regression":
                    m = {k: abs(v) if v is not None else None for k, v in m.items()}
                fitted = learner.fit(df, features, label)
            elapsed = time.time() - t0
            fitted_models[name] = fitted
            rows.append(tuple([name] + [None if m[k] is None else round(float(m[k]), decimals) for k in metric_names]
                              + [round(elapsed, 3)]))
    finally:
        if validation == "train_test":
            train.unpersist()
            flagged.unpersist()
    if problem == "classification":
        rows.sort(key=lambda r: -(r[5] if r[5] is not None else -1))
    else:
        rows.sort(key=lambda r: r[3] if r[3] is not None else float("inf"))
    schema = "model string, " + ", ".join(f"{k} double" for k in metric_names) + ", fit_time double"
    return spark.createDataFrame(rows, schema), fitted_models


def _mean(vals):
    vals = [v for v in vals if v is not None]
    return sum(vals) / len(vals) if vals else None
