"""Model interpretation.

Shapley values, LIME and permutation importance are all expressed as one
model ``transform`` over an expanded table followed by group-bys, so the
model is applied by the cluster in batches and nothing row-level reaches
the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.exprs import gauss, keyed_permutation, row_key
from tabloom.functions.scan import row_numbers
from tabloom.operators.models import Fitted, SparkMLLearner
from tabloom.session import cut_lineage, scratch_path, spread


def _output(fitted: Fitted, scored: DataFrame, class_index: int | None) -> "F.Column":
    if class_index is not None and "probability" in scored.columns:
        return vector_to_array("probability")[class_index]
    return F.col("prediction")


def shap_linear(fitted: Fitted, df: DataFrame, key_cols: list[str], background: DataFrame | None = None,
                class_row: int = 0) -> DataFrame:
    """Exact SHAP of a linear model with independent features: ``coef_j * (x_j - mean_j)`` (long form)."""
    m = fitted.last_stage
    if hasattr(m, "coefficientMatrix") and getattr(m, "numClasses", 2) > 2:
        coef = m.coefficientMatrix.toArray()[class_row]
    else:
        coef = m.coefficients.toArray()
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(f).alias(f) for f in fitted.features]).collect()[0]
    pairs = []
    for j, f in enumerate(fitted.features):
        pairs += [F.lit(f), F.struct(F.col(f).cast("double").alias("value"),
                                     (F.lit(float(coef[j])) * (F.col(f) - F.lit(means[f]))).alias("shap"))]
    long = df.select(*key_cols, F.stack(F.lit(len(fitted.features)), *pairs).alias("feature", "s"))
    return long.select(*key_cols, "feature", "s.value", "s.shap")


def shap_values(fitted: Fitted, df: DataFrame, key_cols: list[str], background: DataFrame,
                class_index: int | None = None, n_centres: int = 10, seed: int = 7) -> DataFrame:
    """Shapley values by the rule that fits the model (long form ``key, feature, shap``).

    Linear and logistic models: :func:`shap_linear`; trees, forests and boosted trees: exact tree
    paths; any other model: the kernel rule against k-means centres of ``background``.
    """
    from tabloom.operators.shapley import shap_kernel, shap_tree, tree_sum
    m = fitted.last_stage
    if hasattr(m, "coefficientMatrix") or hasattr(m, "coefficients"):
        return shap_linear(fitted, df, key_cols, background, class_index or 0).drop("value")
    if tree_sum(fitted, df.sparkSession, class_index) is not None:
        return shap_tree(fitted, df, key_cols, class_index)
    return shap_kernel(fitted, df, key_cols, background, n_centres, class_index, seed=seed)


CHAIN_FEATURES = 12   # features up to which the hybrid points of a row are columns (one run of the model each)


def _chain_outputs(fitted: Fitted, base: DataFrame, key_cols: list[str], class_index: int | None) -> DataFrame:
    """(keys, _perm, _f): the model's outputs of a row's hybrid points, from all background to all its own."""
    feats = fitted.features
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)]
    cur = base.select(*keys, "_perm", *[F.col(f).alias(f"_x{j}") for j, f in enumerate(feats)],
                      *[F.col(f"_b_{f}").alias(f"_b{j}") for j, f in enumerate(feats)])
    for t in range(len(feats) + 1):
        points = cur.withColumns({f: F.when(F.array_position("_perm", F.lit(j)) <= t, F.col(f"_x{j}")).otherwise(F.col(f"_b{j}"))
                                  for j, f in enumerate(feats)})
        scored = fitted.transform(points)
        cur = scored.select(*cur.columns, _output(fitted, scored, class_index).alias(f"_f{t}"))
    return cur.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key_cols)], "_perm",
                      F.array(*[F.col(f"_f{t}") for t in range(len(feats) + 1)]).alias("_f"))


def shap_sampled(fitted: Fitted, df: DataFrame, key_cols: list[str], background: DataFrame,
                 n_perm: int = 8, class_index: int | None = None, seed: int = 7) -> DataFrame:
    """Permutation-sampling Shapley values for any model (long form ``key, feature, shap``).

    For every explained row and each of ``n_perm`` seeded feature orders, a
    chain of hybrid points walks from a hash-chosen background row to the
    row one feature at a time; each step's change of the model output is
    credited to the feature switched.  Per row the values add up to the
    output minus the mean output of its background points.
    """
    feats = fitted.features
    p = len(feats)
    nb_rows = background.count()
    # Background rows numbered in (feature hash, features) order.  When the background carries the
    # row key, a key hash comes second, so a feature vector repeated in a third of the rows is split
    # over many buckets of the row numbering; identical rows keep the same features, so any
    # order among them picks the same points.
    bkeys = list(key_cols) if all(c in background.columns for c in key_cols) else []
    bsrc = background.select(*feats, *bkeys).withColumn("_h", F.xxhash64(F.lit(seed), *feats))
    border = ["_h"] + feats
    if bkeys:
        bsrc = bsrc.withColumn("_hk", F.xxhash64(F.lit(seed), *bkeys))
        border = ["_h", "_hk"] + feats + bkeys
    bg = row_numbers(bsrc, border, name="_bidx")
    bg = bg.select("_bidx", *[F.col(f).alias(f"_b_{f}") for f in feats])
    key = row_key(key_cols)
    base = df.select(*key_cols, *feats).withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    base = base.withColumn("_bidx", F.pmod(F.xxhash64(F.lit(seed), key, F.col("_m")), F.lit(nb_rows)) + 1)
    base = base.join(bg, "_bidx")
    # seeded feature order for each (row, permutation)
    order = F.array_sort(F.array(*[F.struct(F.xxhash64(F.lit(seed + 1), key, F.col("_m"), F.lit(j)).alias("h"),
                                            F.lit(j).alias("j")) for j in range(p)]))
    base = base.withColumn("_perm", F.transform(order, lambda s: s["j"]))
    names = F.array(*[F.lit(f) for f in feats])
    if isinstance(fitted.model, PipelineModel) and p <= CHAIN_FEATURES:
        # the points of a row and order stand side by side: nothing is exploded, sorted or looked back at
        outputs = _chain_outputs(fitted, base, key_cols, class_index)
        at = [F.array_position(F.col("_perm"), F.lit(j)).cast("int") for j in range(p)]   # the step that switches j
        sums = outputs.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n"), *[
            F.avg(F.get("_f", a) - F.get("_f", a - 1)).alias(f"_d{j}") for j, a in enumerate(at)])
        # rows that share a key share its values
        shap = F.array(*[F.col(f"_d{j}") * (F.lit(n_perm) / F.col("_n")) for j in range(p)])
        return sums.select(*key_cols, F.explode(F.arrays_zip(names.alias("feature"), shap.alias("shap"))).alias("_s")) \
            .select(*key_cols, "_s.feature", "_s.shap")
    chain = base.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(p))))
    hybrid = {}
    for j, f in enumerate(feats):
        pos = F.array_position(F.col("_perm"), F.lit(j)) - 1  # 0-based position of feature j
        hybrid[f] = F.when(pos < F.col("_t"), F.col(f)).otherwise(F.col(f"_b_{f}"))
    pts = chain.select(*key_cols, "_m", "_t", "_perm", *[e.alias(f) for f, e in hybrid.items()])
    scored = fitted.transform(pts)
    out = scored.select(*key_cols, "_m", "_t", "_perm", _output(fitted, scored, class_index).alias("_f"))
    w = Window.partitionBy(*key_cols, "_m").orderBy("_t")
    steps = out.withColumn("_d", F.col("_f") - F.lag("_f").over(w)).where(F.col("_t") > 0)
    steps = steps.withColumn("_j", F.element_at(F.col("_perm"), F.col("_t")))
    return (steps.groupBy(*key_cols, "_j").agg(F.avg("_d").alias("shap"))
            .select(*key_cols, F.element_at(names, F.col("_j") + 1).alias("feature"), "shap"))


def shap_summary(shap_long: DataFrame) -> DataFrame:
    """Global importance: mean absolute SHAP per feature."""
    return shap_long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def shap_local(fitted: Fitted, df: DataFrame, key_cols: list[str], key_values: dict, background: DataFrame,
               n_perm: int | None = None, class_index: int | None = None, seed: int = 7) -> DataFrame:
    """SHAP of one row with its actual and predicted values; ``n_perm`` asks for sampled feature orders instead."""
    cond = F.lit(True)
    for k, v in key_values.items():
        cond = cond & (F.col(k) == F.lit(v))
    row = df.where(cond)
    shap = shap_values(fitted, row, key_cols, background, class_index, seed=seed) if n_perm is None else \
        shap_sampled(fitted, row, key_cols, background, n_perm, class_index, seed)
    scored = fitted.transform(row)
    pred = scored.select(*key_cols, F.col(fitted.label).alias("actual"), F.col("prediction").alias("predicted"))
    return shap.join(pred, key_cols)


LIME_SUMS = 12   # features up to which a row's ridge is solved from sums of products (columns of one aggregate)


def lime(fitted: Fitted, df: DataFrame, key_cols: list[str], train: DataFrame, n_samples: int = 100,
         kernel_width: float | None = None, class_index: int | None = None, alpha: float = 1.0,
         seed: int = 7) -> DataFrame:
    """Local linear surrogate per row: seeded Gaussian perturbations, kernel weights, weighted ridge."""
    feats = fitted.features
    p = len(feats)
    kw = kernel_width or 0.75 * np.sqrt(p)
    sd = train.agg(*[F.stddev_samp(f).alias(f) for f in feats]).collect()[0]
    scale = {f: (sd[f] or 1.0) for f in feats}
    key = row_key(key_cols)
    pts = df.select(*key_cols, *feats).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    zcols = {}
    for j, f in enumerate(feats):
        z = gauss(F.lit(seed), key, F.col("_s"), F.lit(j))
        zcols[f"_z{j}"] = F.when(F.col("_s") == 0, F.lit(0.0)).otherwise(z)   # sample 0 is the row itself
    pts = pts.withColumns(zcols)
    pts = pts.withColumns({f: F.col(f) + F.col(f"_z{j}") * F.lit(scale[f]) for j, f in enumerate(feats)})
    scored = fitted.transform(pts)
    dist = F.sqrt(sum((F.col(f"_z{j}") * F.col(f"_z{j}") for j in range(p)), F.lit(0.0)))
    sample = scored.select(*key_cols, *[F.col(f"_z{j}") for j in range(p)],
                           _output(fitted, scored, class_index).alias("_y"),
                           F.sqrt(F.exp(-(dist * dist) / F.lit(kw * kw))).alias("_w"))

    out_schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in key_cols]) + \
        ", feature string, weight double, intercept double, local_pred double"

    if p <= LIME_SUMS:
        # the ridge needs only weighted sums: the points of a row are added up, no group reaches Python
        y = F.coalesce(F.col("_y").cast("double"), F.lit(float("nan")))
        z = [F.col(f"_z{j}") for j in range(p)]
        terms = [F.lit(1.0), y, *z, *[v * y for v in z], *[z[j] * z[k] for j in range(p) for k in range(j, p)]]
        sums = sample.groupBy(*key_cols).agg(*[F.sum(F.col("_w") * v).alias(f"_s{i}") for i, v in enumerate(terms)])

        @F.pandas_udf("array<double>")
        def solved(*cols: pd.Series) -> pd.Series:
            return pd.Series(list(ridge_of_sums(np.column_stack([c.to_numpy(float) for c in cols]), p, alpha)))

        fits = sums.select(*key_cols, solved(*[F.col(f"_s{i}") for i in range(len(terms))]).alias("_c"))
        names = F.array(*[F.lit(f) for f in feats])
        # the explained row sits at z = 0, so the surrogate's value there is the intercept
        return fits.select(*key_cols, "_c", F.explode(F.arrays_zip(names.alias("feature"), F.slice("_c", 1, p).alias("weight"))).alias("_s")) \
            .select(*key_cols, "_s.feature", "_s.weight", F.col("_c")[p].alias("intercept"), F.col("_c")[p].alias("local_pred"))

    def ridge(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[[f"_z{j}" for j in range(p)]].to_numpy(dtype=float)
        y = pdf["_y"].to_numpy(dtype=float)
        w = pdf["_w"].to_numpy(dtype=float)
        xm = np.average(x, axis=0, weights=w)
        ym = np.average(y, weights=w)
        xc, yc = x - xm, y - ym
        a = (xc * w[:, None]).T @ xc + alpha * np.eye(p)
        coef = np.linalg.solve(a, (xc * w[:, None]).T @ yc)
        icpt = ym - xm @ coef
        out = {k: [pdf[k].iloc[0]] * p for k in key_cols}
        # the explained row sits at z = 0, so the surrogate's value there is the intercept
        out.update({"feature": feats, "weight": coef.tolist(), "intercept": [float(icpt)] * p,
                    "local_pred": [float(icpt)] * p})
        return pd.DataFrame(out)

    return sample.groupBy(*key_cols).applyInPandas(ridge, out_schema)


def ridge_of_sums(sums: np.ndarray, p: int, alpha: float) -> np.ndarray:
    """Coefficients and intercept of every row's weighted ridge.

    Columns of ``sums``: those of w, wy, wx (p), wxy (p), then wxx of the upper triangle.
    """
    w, sy, sx, sxy = sums[:, 0], sums[:, 1], sums[:, 2:2 + p], sums[:, 2 + p:2 + 2 * p]
    a = np.empty((len(sums), p, p))
    j, k = np.triu_indices(p)
    a[:, j, k] = a[:, k, j] = sums[:, 2 + 2 * p:]
    mean = sx / w[:, None]
    a += alpha * np.eye(p) - mean[:, :, None] * sx[:, None, :]
    coef = np.linalg.solve(a, (sxy - mean * sy[:, None])[:, :, None])[:, :, 0]
    return np.column_stack((coef, (sy - (sx * coef).sum(axis=1)) / w))


def _normal_cdf(v: float) -> float:
    return 0.5 * (1 + math.erf(v / math.sqrt(2)))


def lime_bins(train: DataFrame, features: list[str]) -> dict[str, dict]:
    """Per feature: quartile cuts and, per bin, the training share, mean, deviation, least and largest value."""
    from tabloom.functions.quantile import quantile_table
    q = quantile_table(train, features, [0.25, 0.5, 0.75]).first()
    out = {}
    aggs = []
    for j, f in enumerate(features):
        cuts = sorted(set(q[f] or []))
        bin_ = sum((F.when(F.col(f) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
        out[f] = {"cuts": cuts}
        for b in range(len(cuts) + 1):
            v = F.when(bin_ == b, F.col(f).cast("double"))
            aggs += [F.count(v).alias(f"n_{j}_{b}"), F.avg(v).alias(f"m_{j}_{b}"), F.stddev_pop(v).alias(f"s_{j}_{b}"),
                     F.min(v).alias(f"lo_{j}_{b}"), F.max(v).alias(f"hi_{j}_{b}")]
    r = train.agg(*aggs).first()
    for j, f in enumerate(features):
        bins = range(len(out[f]["cuts"]) + 1)
        total = sum(r[f"n_{j}_{b}"] for b in bins) or 1
        out[f]["bins"] = [{"share": r[f"n_{j}_{b}"] / total, **{k: r[f"{k}_{j}_{b}"] for k in ("m", "s", "lo", "hi")}} for b in bins]
    return out


def lime_sample(bins: dict, feature: str, *seed) -> tuple:
    """(bin, value) of a seeded draw: a bin by its training share, then a value of its truncated normal."""
    from tabloom.functions.exprs import hash_unit, norm_ppf
    u, v = hash_unit(F.lit(1), *seed), hash_unit(F.lit(2), *seed)
    place, upto = F.lit(0), 0.0
    for b, one in enumerate(bins[feature]["bins"][:-1]):
        upto += one["share"]
        place = place + F.when(u >= upto, 1).otherwise(0)
    rows = []
    for one in bins[feature]["bins"]:
        m, dev = one["m"], one["s"] or 0.0
        ends = [_normal_cdf((one[k] - m) / dev) if m is not None and dev else 0.5 for k in ("lo", "hi")]
        rows.append((m, dev, *ends, one["lo"], one["hi"]))
    m, dev, low, high, least, most = (F.get(F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in col]), place)
                                      for col in zip(*rows))
    p = low + v * (high - low)
    # the share is computed once: the inverse normal names it many times
    normal = F.transform(F.array(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1 - 1e-16))), norm_ppf)[0]
    value = F.least(F.greatest(m + dev * normal, least), most)
    return place, value


def surrogate(sums: np.ndarray, p: int, num_features: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights with 0 where a feature is not chosen, intercepts) of weighted ridge fits, all rows at once.

    ``sums``: rows x (1 + 2 p + 1 + p (p + 1) / 2): w, w z_i, w y, w z_i y, w z_i z_j (i <= j).  Up to six
    features are chosen one by one by the explained variance, more by the largest weights of a fit of all.
    """
    n = len(sums)
    w, zy = sums[:, 0], sums[:, 2 + p:2 + 2 * p]
    mean, my = sums[:, 1:1 + p] / w[:, None], sums[:, 1 + p] / w
    gram = np.zeros((n, p, p))
    i, j = np.triu_indices(p)
    gram[:, i, j] = sums[:, 2 + 2 * p:]
    gram[:, j, i] = sums[:, 2 + 2 * p:]
    a = gram - w[:, None, None] * mean[:, :, None] * mean[:, None, :]
    b = zy - w[:, None] * mean * my[:, None]

    def fit(chosen: np.ndarray, ridge: float) -> np.ndarray:
        """Weights with the features outside ``chosen`` (rows x p) held at 0."""
        both = chosen[:, :, None] & chosen[:, None, :]
        m = np.where(both, a, 0.0)
        k = np.arange(p)
        m[:, k, k] = np.where(chosen, a[:, k, k] + ridge, 1.0)
        # a feature that never varies beside the others: the least weights
        return np.einsum("nij,nj->ni", np.linalg.pinv(m, hermitian=True), np.where(chosen, b, 0.0))

    most = min(num_features, p)
    chosen = np.zeros((n, p), bool)
    if most == p:
        chosen[:] = True
    elif most <= 6:
        rows = np.arange(n)
        for _ in range(most):
            gain = np.full((n, p), -np.inf)
            for f in range(p):
                trial = chosen.copy()
                trial[:, f] = True
                c = fit(trial, 0.0)
                gain[:, f] = np.where(chosen[:, f], -np.inf, 2 * (c * b).sum(1) - np.einsum("ni,nij,nj->n", c, a, c))
            chosen[rows, gain.round(12).argmax(axis=1)] = True
    else:
        size = -np.abs(fit(np.ones((n, p), bool), 0.01))
        np.put_along_axis(chosen, np.argsort(size, axis=1, kind="stable")[:, :most], True, axis=1)
    coef = np.where(chosen, fit(chosen, alpha), 0.0)
    return coef, my - (mean * coef).sum(axis=1)


def lime_binned(fitted: Fitted, df: DataFrame, key_cols: list[str], train: DataFrame, n_samples: int = 5000,
                num_features: int = 10, kernel_width: float | None = None, class_index: int | None = None,
                alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """Local surrogates on quartile bins (long form ``key, feature, rule, weight, intercept, local_pred``).

    Each explained row is met with ``n_samples`` points, the row itself first; a point's features are drawn from the
    bins of the training data, and the surrogate sees only whether each lies in the row's own bin.  The sums of the
    weighted fit are one grouped aggregate; the small fits of many rows are solved together in one Arrow UDF.
    Only the chosen features are listed.
    """
    feats, p = fitted.features, len(fitted.features)
    kw = kernel_width or 0.75 * math.sqrt(p)
    bins = lime_bins(train, feats)
    key = row_key(key_cols)
    own, rules = {}, {}
    for f in feats:
        cuts = bins[f]["cuts"]
        own[f] = sum((F.when(F.col(f) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
        names = [f"{f} <= {cuts[0]:.2f}"] + [f"{a:.2f} < {f} <= {b:.2f}" for a, b in zip(cuts, cuts[1:])] + [f"{f} > {cuts[-1]:.2f}"] \
            if cuts else [f]
        rules[f] = F.get(F.array(*[F.lit(x) for x in names]), own[f])
    pts = df.select(*key_cols, *feats).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    drawn = {}
    for j, f in enumerate(feats):
        place, value = lime_sample(bins, f, F.lit(seed), key, F.col("_s"), F.lit(j))
        first = F.col("_s") == 0
        drawn[f"_z{j}"] = F.when(first | (place == own[f]), 1.0).otherwise(0.0)
        drawn[f"_v{j}"] = F.when(first, F.col(f).cast("double")).otherwise(value)
    pts = pts.select(*key_cols, "_s", *[c.alias(n) for n, c in drawn.items()])
    pts = pts.select(*key_cols, "_s", *[f"_z{j}" for j in range(p)], *[F.col(f"_v{j}").alias(f) for j, f in enumerate(feats)])
    scored = _with_point_key(fitted, [*key_cols, "_s"]).transform(pts)
    y = _output(fitted, scored, class_index)
    missing = sum(((1 - F.col(f"_z{j}")) for j in range(p)), F.lit(0.0))
    w = F.sqrt(F.exp(-missing / F.lit(kw * kw)))
    rows = scored.select(*key_cols, "_s", y.alias("_y"), w.alias("_w"), *[f"_z{j}" for j in range(p)])
    z = [F.col(f"_z{j}") for j in range(p)]
    terms = [F.col("_w")] + [F.col("_w") * v for v in z] + [F.col("_w") * F.col("_y")] + [F.col("_w") * v * F.col("_y") for v in z]
    terms += [F.col("_w") * z[i] * z[j] for i in range(p) for j in range(i, p)]
    sums = rows.groupBy(*key_cols).agg(*[F.sum(t).alias(f"_t{k}") for k, t in enumerate(terms)])

    @F.pandas_udf("struct<coef:array<double>,intercept:double>")
    def solve(*cols: pd.Series) -> pd.DataFrame:
        coef, intercept = surrogate(np.column_stack([c.to_numpy(float) for c in cols]), p, num_features, alpha)
        return pd.DataFrame({"coef": list(coef), "intercept": intercept})

    fits = sums.select(*key_cols, solve(*[F.col(f"_t{k}") for k in range(len(terms))]).alias("_f"))
    named = df.select(*key_cols, *[rules[f].alias(f"_r{j}") for j, f in enumerate(feats)])
    listed = F.arrays_zip(F.array(*[F.lit(f) for f in feats]).alias("feature"), F.array(*[F.col(f"_r{j}") for j in range(p)]).alias("rule"),
                          F.col("_f.coef").alias("weight"))
    total = F.aggregate("_f.coef", F.col("_f.intercept"), lambda a, c: a + c)
    return named.join(fits, key_cols).select(*key_cols, F.explode(listed).alias("_l"), F.col("_f.intercept").alias("intercept"),
                                             total.alias("local_pred")).where(F.col("_l.weight") != 0).select(
        *key_cols, "_l.feature", "_l.rule", "_l.weight", "intercept", "local_pred")


# repeats per fold where none are asked for
REPEATS = {"classification": 5, "regression": 100}


def permutation_importance(learner, df: DataFrame, features: list[str], label: str, problem: str,
                           key_cols: list[str], folds: int = 5, repeats: int | None = None, seed: int = 7) -> DataFrame:
    """Mean and spread of the score drop when one feature is shuffled inside the held-out fold.

    All (feature, repeat) shuffles of a fold are one plan: the fold's rows are numbered once in a seeded
    hash order, every shuffle is a keyed permutation of those numbers, and one transform of the model
    and one grouped aggregate score them all, the unshuffled rows among them.
    """
    from tabloom.operators.split import kfold, stratified_kfold

    repeats = REPEATS[problem] if repeats is None else repeats
    folded = (stratified_kfold(df, key_cols, label, folds, seed) if problem == "classification"
              else kfold(df, key_cols, folds, seed))
    folded = cut_lineage(folded.select(*dict.fromkeys([*key_cols, *features, label]), "fold"))
    key = row_key(key_cols)
    drops = {f: [] for f in features}
    # shuffle 0 leaves the rows as they are; the others are feature * repeats + repeat + 1
    shuffles = F.sequence(F.lit(0), F.lit(len(features) * repeats))
    for fo in range(folds):
        train = folded.where(F.col("fold") != fo).drop("fold")
        test = folded.where(F.col("fold") == fo).drop("fold")
        fitted = learner.fit(train, features, label)
        rows = cut_lineage(row_numbers(test.select(*features, F.col(label), F.xxhash64(F.lit(seed), key).alias("_h"), *[
            F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)]), ["_h", *[f"_k{i}" for i in range(len(key_cols))]], name="_i",
            hashed=True))
        n = rows.count()
        if not n:
            continue
        rows = rows.select((F.col("_i") - 1).alias("_i"), *features, label)
        # few rows become many points: they are dealt over all cores first
        each = spread(rows).withColumn("_s", F.explode(shuffles))
        each = each.withColumn("_from", F.when(F.col("_s") == 0, F.col("_i")).otherwise(
            keyed_permutation(F.col("_i"), n, F.lit(seed + fo), F.col("_s"))))
        partner = rows.select(F.col("_i").alias("_from"), *[F.col(f).alias(f"_p{j}") for j, f in enumerate(features)])
        own = F.floor((F.col("_s") - 1) / F.lit(repeats))
        mixed = each.join(partner, "_from").select("_s", label, "_i", *[
            F.when((F.col("_s") > 0) & (own == j), F.col(f"_p{j}")).otherwise(F.col(f)).alias(f) for j, f in enumerate(features)])
        scored = _with_point_key(fitted, ["_s", "_i"]).transform(mixed)
        hit = F.avg((F.col("prediction") == F.col(label)).cast("double")) if problem == "classification" else \
            1 - F.avg(F.pow(F.col(label) - F.col("prediction"), 2)) / F.var_pop(F.col(label))
        scores = {r["_s"]: r["v"] for r in scored.groupBy("_s").agg(hit.alias("v")).collect()}
        for j, f in enumerate(features):
            drops[f] += [scores[0] - scores[j * repeats + r + 1] for r in range(repeats)]
    rows = [(f, float(np.mean(v)), float(np.std(v))) for f, v in drops.items()]
    rows.sort(key=lambda t: -t[1])
    return df.sparkSession.createDataFrame(rows, "feature string, importance_mean double, importance_std double")


def _with_point_key(fitted: Fitted, key_cols: list[str]) -> Fitted:
    from tabloom.operators.shapley import _keyed
    return _keyed(fitted, key_cols)


def correlated_transform(coef: np.ndarray, cov: np.ndarray, max_exact: int = 12, orders: int = 1000, seed: int = 7) -> np.ndarray:
    """Matrix T with Shapley values T (x - mean) of a linear model under correlated (Gaussian) features.

    A subset's value is the model at the conditional expectation of the other features.  Up to
    ``max_exact`` features every subset is used; beyond, ``orders`` seeded feature orders and their reverses.
    """
    p = len(coef)
    known: dict[int, np.ndarray] = {}

    def row(mask: int) -> np.ndarray:
        """The subset's value as a linear form of x - mean."""
        if mask not in known:
            s = [j for j in range(p) if mask >> j & 1]
            out = np.zeros(p)
            if s:
                out[s] = coef @ cov[:, s] @ np.linalg.pinv(cov[np.ix_(s, s)], hermitian=True)
            known[mask] = out
        return known[mask]

    t = np.zeros((p, p))
    if p <= max_exact:
        share = [1.0 / (p * math.comb(p - 1, k)) for k in range(p)]
        for mask in range(1 << p):
            for i in range(p):
                if not mask >> i & 1:
                    t[i] += share[mask.bit_count()] * (row(mask | 1 << i) - row(mask))
        return t
    rng = np.random.default_rng(seed)
    for _ in range(orders):
        order = rng.permutation(p)
        for way in (order, order[::-1]):
            known.clear()       # masks rarely meet again
            mask = 0
            for i in way.tolist():
                t[i] += (row(mask | 1 << i) - row(mask)) / (2 * orders)
                mask |= 1 << i
    return t


def shap_linear_correlated(fitted: Fitted, df: DataFrame, key_cols: list[str], background: DataFrame | None = None,
                           class_row: int = 0, max_exact: int = 12, orders: int = 1000, seed: int = 7) -> DataFrame:
    """Shapley values of a linear model that allow for correlated features (long form ``key, feature, value, shap``).

    Means and covariances of the background come from one pass; each row's values are one fixed
    features x features matrix applied to it.
    """
    from tabloom.operators.batchfit import feature_vector, fold_moments
    m = fitted.last_stage
    coef = m.coefficientMatrix.toArray()[class_row] if getattr(m, "numClasses", 2) > 2 else m.coefficients.toArray()
    feats, p = fitted.features, len(fitted.features)
    bg = background if background is not None else df
    rows = bg.where(" and ".join(f"`{f}` is not null and not isnan(`{f}`)" for f in feats)).select(
        feature_vector(bg, feats).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("part"))
    n, mean, s = fold_moments(rows, p)[0]
    t = correlated_transform(np.asarray(coef, float), s[:p, :p] / n, max_exact, orders, seed)
    pairs = []
    for i, f in enumerate(feats):
        value = sum((F.lit(float(t[i, j])) * (F.col(g).cast("double") - F.lit(float(mean[j]))) for j, g in enumerate(feats)), F.lit(0.0))
        pairs += [F.lit(f), F.struct(F.col(f).cast("double").alias("value"), value.alias("shap"))]
    return df.select(*key_cols, F.stack(F.lit(p), *pairs).alias("feature", "s")).select(*key_cols, "feature", "s.value", "s.shap")


def tree_rules(df: DataFrame, features: list[str], label: str, problem: str = "classification",
               depth: int = 2) -> DataFrame:
    """Fit a shallow tree and return its nodes with the path rule that reaches each one."""
    spark = df.sparkSession
    est = (lambda d, l: DecisionTreeClassifier(maxDepth=depth, seed=7)) if problem == "classification" else \
        (lambda d, l: DecisionTreeRegressor(maxDepth=depth, seed=7))
    fitted = SparkMLLearner("Decision Tree", problem, est).fit(df, features, label)
    path = scratch_path(spark, "tree")
    fitted.last_stage.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:          # older layout nests the node fields
        data = data.select("nodeData.*")
    nodes = {r["id"]: r for r in data.collect()}
    rows, stack = [], [(0, "", 0)]
    while stack:
        nid, rule, d = stack.pop()
        n = nodes[nid]
        leaf = n["leftChild"] < 0
        feat = None if leaf else features[n["split"]["featureIndex"]]
        thr = None if leaf else float(n["split"]["leftCategoriesOrThreshold"][0])
        rows.append((nid, d, rule or "(root)", feat, thr, float(n["prediction"]), float(n["impurity"]),
                     int(n["rawCount"]), leaf))
        if not leaf:
            left = f"{rule} and " if rule else ""
            stack.append((n["rightChild"], f"{left}{feat} > {thr:.6g}", d + 1))
            stack.append((n["leftChild"], f"{left}{feat} <= {thr:.6g}", d + 1))
    rows.sort()
    return spark.createDataFrame(rows, "node int, depth int, rule string, feature string, threshold double, "
                                       "prediction double, impurity double, count long, leaf boolean")
