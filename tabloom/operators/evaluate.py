"""Model evaluation (Q1-Q12).

Classification metrics come from confusion counts (one ``groupBy(y, pred)``;
at most labels x labels rows reach the driver).  Score curves aggregate by
distinct score first, then use the distributed running sums of
:mod:`tabloom.functions.scan`, so no single-partition window is needed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import norm_ppf
from tabloom.functions.scan import prefix_sums, row_numbers


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def _counts(df: DataFrame, y: str, pred: str) -> dict:
    return {(r["actual"], r["predicted"]): r["count"] for r in confusion_matrix(df, y, pred).collect()}


def _weighted(counts: dict, labels: list) -> tuple[float, float, float]:
    support = {l: sum(n for (a, p), n in counts.items() if a == l) for l in labels}
    npred = {l: sum(n for (a, p), n in counts.items() if p == l) for l in labels}
    tp = {l: counts.get((l, l), 0) for l in labels}
    tot = sum(support.values())
    if tot == 0:
        return 0.0, 0.0, 0.0
    ps = rs = fs = 0.0
    for l in labels:
        p = tp[l] / npred[l] if npred[l] > 0 else 0.0
        r = tp[l] / support[l] if support[l] > 0 else 0.0
        f = 2 * p * r / (p + r) if p + r > 0 else 0.0
        ps += p * support[l]
        rs += r * support[l]
        fs += f * support[l]
    return ps / tot, rs / tot, fs / tot


def _hard_auc(counts: dict, positive) -> float | None:
    """ROC AUC of 0/1 predictions for one class against the rest: (TPR + TNR) / 2."""
    tp = sum(n for (a, p), n in counts.items() if a == positive and p == positive)
    fn = sum(n for (a, p), n in counts.items() if a == positive and p != positive)
    fp = sum(n for (a, p), n in counts.items() if a != positive and p == positive)
    tn = sum(n for (a, p), n in counts.items() if a != positive and p != positive)
    if tp + fn == 0 or fp + tn == 0:
        return None
    return (tp / (tp + fn) + tn / (tn + fp)) / 2


def auc_multiclass_hard(counts: dict) -> float:
    """Mean over true classes of the one-vs-rest AUC of hard predictions."""
    classes = sorted({a for (a, _) in counts})
    vals = [v for v in (_hard_auc(counts, c) for c in classes) if v is not None]
    return float(np.mean(vals)) if vals else float("nan")


def classification_metrics(df: DataFrame, y: str, pred: str, average_over: str = "predicted") -> DataFrame:
    """Accuracy, weighted precision/recall/F1 and ROC AUC from hard labels.

    ``average_over='predicted'`` weights only labels that were predicted (the
    train/test rule); ``'all'`` uses every label (the cross-validation rule).
    """
    counts = _counts(df.where(F.col(y).isNotNull()), y, pred)
    total = sum(counts.values())
    acc = sum(n for (a, p), n in counts.items() if a == p) / total if total else 0.0
    if average_over == "predicted":
        labels = sorted({p for (_, p) in counts if p is not None})
    else:
        labels = sorted({x for k in counts for x in k if x is not None})
    prec, rec, f1 = _weighted(counts, labels)
    classes = sorted({a for (a, _) in counts})
    auc = _hard_auc(counts, max(classes)) if len(classes) <= 2 else auc_multiclass_hard(counts)
    return df.sparkSession.createDataFrame(
        [(float(acc), float(prec), float(rec), float(f1), None if auc is None else float(auc))],
        "accuracy double, precision_weighted double, recall_weighted double, f1_weighted double, roc_auc double")


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """MAE, MSE, RMSE, R^2 and explained variance in one aggregate, over rows with both values."""
    df = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(y) - F.col(pred)
    agg = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                 F.var_pop(F.col(y)).alias("vy"), F.var_pop(e).alias("ve"))
    return agg.select("mae", "mse", F.sqrt("mse").alias("rmse"),
                      (1 - F.col("mse") / F.col("vy")).alias("r2"),
                      (1 - F.col("ve") / F.col("vy")).alias("explained_variance"))


def _score_counts(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    is_pos = (F.col(y) == F.lit(positive)).cast("long")
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(is_pos).alias("pos"),
                                                       F.sum(1 - is_pos).alias("neg"))


def _totals(sc: DataFrame) -> tuple[int, int]:
    r = sc.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()[0]
    return r["p"] or 0, r["n"] or 0


def roc_auc(df: DataFrame, y: str, score: str, positive=1) -> float:
    """Area under the ROC curve (ties count one half), exact."""
    sc = _score_counts(df, y, score, positive)
    below = prefix_sums(sc, ["score"], {"below": "neg"}, inclusive=False)
    r = below.agg(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("s"),
                  F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()[0]
    if not r["p"] or not r["n"]:
        return float("nan")
    return float(r["s"] / (r["p"] * r["n"]))


def roc_auc_ovr_weighted(df: DataFrame, y: str, prob_cols: dict) -> float:
    """Support-weighted one-vs-rest AUC from per-class probability columns ``{label: column}``."""
    support = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    tot = sum(support.get(c, 0) for c in prob_cols)
    return float(sum(roc_auc(df, y, col, c) * support.get(c, 0) for c, col in prob_cols.items()) / tot)


def _curve(df, y, score, positive=1):
    sc = _score_counts(df, y, score, positive).withColumn("_neg_score", -F.col("score"))
    cum = prefix_sums(sc, ["_neg_score"], {"tp": "pos", "fp": "neg"})
    return cum, _totals(sc)


def roc_curve(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """One point per distinct score: predicting positive when score >= threshold."""
    cum, (p, n) = _curve(df, y, score, positive)
    return cum.select(F.col("score").alias("threshold"), "tp", "fp",
                      (F.col("tp") / F.lit(p)).alias("tpr"), (F.col("fp") / F.lit(n)).alias("fpr"))


def pr_curve(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    cum, (p, _) = _curve(df, y, score, positive)
    return cum.select(F.col("score").alias("threshold"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                      (F.col("tp") / F.lit(p)).alias("recall"))


def _ovr_long(df: DataFrame, y: str, prob_cols: dict) -> DataFrame:
    """One row per (row, class): the class's score and whether the row belongs to it."""
    pairs = []
    for c, col in prob_cols.items():
        pairs += [F.lit(str(c)), F.struct(F.col(col).cast("double").alias("s"),
                                          (F.col(y) == F.lit(c)).cast("int").alias("t"))]
    return df.select(F.stack(F.lit(len(prob_cols)), *pairs).alias("cls", "v")).select("cls", "v.s", "v.t")


def curves_ovr(df: DataFrame, y: str, prob_cols: dict, kind: str = "roc") -> DataFrame:
    """One-vs-rest ROC or PR curve of every class plus the micro average (all class scores pooled).

    Long form ``(curve, threshold, ...)``; ``curve`` is the class label or ``'micro'``.
    """
    long = _ovr_long(df, y, prob_cols)
    pooled = long.withColumn("cls", F.lit("micro"))
    both = long.unionByName(pooled)
    sc = both.groupBy("cls", F.col("s").alias("score")).agg(F.sum("t").cast("long").alias("pos"),
                                                          F.sum(1 - F.col("t")).cast("long").alias("neg"))
    tot = sc.groupBy("cls").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = prefix_sums(sc.withColumn("_neg_score", -F.col("score")), ["_neg_score"], {"tp": "pos", "fp": "neg"},
                      ["cls"])
    cum = cum.join(tot, "cls")
    if kind == "roc":
        return cum.select(F.col("cls").alias("curve"), F.col("score").alias("threshold"),
                          (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))
    return cum.select(F.col("cls").alias("curve"), F.col("score").alias("threshold"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                      (F.col("tp") / F.col("P")).alias("recall"))


def ks_statistic(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """Largest gap between the two classes' cumulative score shares, and where it is."""
    sc = _score_counts(df, y, score, positive)
    p, n = _totals(sc)
    cum = prefix_sums(sc, ["score"], {"cp": "pos", "cn": "neg"})
    gap = F.abs(F.col("cn") / F.lit(n) - F.col("cp") / F.lit(p))
    # the largest gap, at its smallest score: one aggregate
    best = cum.agg(F.min(F.struct((-gap).alias("g"), F.col("score").alias("t"))).alias("b"))
    return best.select((-F.col("b.g")).alias("ks"), F.col("b.t").alias("threshold"))


def qq_points(df: DataFrame, residual: str, key: str) -> DataFrame:
    """Normal Q-Q points of standardised residuals: plotting positions i / (n + 1)."""
    st = df.agg(F.count(F.col(residual)).alias("n"), F.avg(residual).alias("m"),
                F.stddev_pop(residual).alias("s")).collect()[0]
    d = df.select(key, residual).where(F.col(residual).isNotNull())
    ranked = row_numbers(d, [residual, key], name="i")
    p = F.col("i") / F.lit(st["n"] + 1)
    return ranked.select(key, "i", norm_ppf(p).alias("theoretical"),
                         ((F.col(residual) - F.lit(st["m"])) / F.lit(st["s"])).alias("sample"))


def poly_fit(df: DataFrame, x: str, y: str, order: int = 2) -> dict:
    """Least-squares polynomial of ``y`` on standardised ``x`` from one aggregate (normal equations)."""
    st = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).collect()[0]
    u = (F.col(x) - F.lit(st["m"])) / F.lit(st["s"])
    aggs = [F.sum(F.pow(u, k)).alias(f"u{k}") for k in range(2 * order + 1)]
    aggs += [F.sum(F.pow(u, k) * F.col(y)).alias(f"v{k}") for k in range(order + 1)]
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*aggs).collect()[0]
    a = np.array([[r[f"u{i + j}"] for j in range(order + 1)] for i in range(order + 1)], dtype=float)
    b = np.array([r[f"v{i}"] for i in range(order + 1)], dtype=float)
    coef = np.linalg.solve(a, b)
    return {"x_mean": st["m"], "x_std": st["s"], "coef": [float(c) for c in coef]}


def choose_scoring(df: DataFrame, y: str) -> str:
    n = df.agg(F.count_distinct(F.col(y))).collect()[0][0]
    return "roc_auc" if n <= 2 else "f1_weighted"


def feature_importance(model, features: list[str], spark) -> DataFrame:
    """Coefficients (first class row for a multinomial logistic model) or tree importances, descending."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficientMatrix") and model.numClasses > 2:
        vals = model.coefficientMatrix.toArray()[0].tolist()
    elif hasattr(model, "coefficients"):
        vals = model.coefficients.toArray().tolist()
    else:
        raise ValueError(f"{type(model).__name__} has no importances")
    rows = sorted(zip(features, [float(v) for v in vals]), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, importance double")
