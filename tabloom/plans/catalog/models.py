"""Model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.exprs import round_doubles
from tabloom.operators import evaluate as E
from tabloom.operators.knn import KNNLearner
from tabloom.operators.models import AdaBoost, learners, predict, prediction_histogram
from tabloom.operators.split import hash_split
from tabloom.plans.catalog import register
from tabloom.plans.leaderboard import cross_validate, fit_and_rank, score
from tabloom.sources.tables import f_class, table, with_fixtures

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATS = ["x1", "x2", "x3"]


def _part_xy(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 1000).cast("double").alias("x"),
                                          "p_retailprice")


@register("linreg_part", """SELECT round(regr_intercept(p_retailprice, CAST(p_partkey % 1000 AS DOUBLE)), 6) AS intercept,
  round(regr_slope(p_retailprice, CAST(p_partkey % 1000 AS DOUBLE)), 6) AS slope FROM part""")
def linreg_part(spark, sf):
    fitted = learners("regression")["Linear Regression"].fit(_part_xy(spark, sf), ["x"], "p_retailprice")
    lm = fitted.last_stage
    return spark.createDataFrame([(round(float(lm.intercept), 6), round(float(lm.coefficients[0]), 6))],
                                 "intercept double, slope double")


def _emb2(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("e0"),
                    F.col("embedding")[1].cast("double").alias("e1"), F.col("label").cast("double").alias("label"))


@register("gnb_embeddings_2d", """WITH d AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1,
  label FROM embeddings),
g AS (SELECT 1e-9 * greatest(var_pop(e0), var_pop(e1)) AS eps, count(*) AS n FROM d),
c AS (SELECT label, count(*) AS nc, avg(e0) AS m0, avg(e1) AS m1, var_pop(e0) AS v0, var_pop(e1) AS v1 FROM d GROUP BY label),
s AS (SELECT d.vec_id, c.label, ln(nc) - ln(n)
        - 0.5 * ln(2 * pi() * (v0 + eps)) - (e0 - m0) * (e0 - m0) / (2 * (v0 + eps))
        - 0.5 * ln(2 * pi() * (v1 + eps)) - (e1 - m1) * (e1 - m1) / (2 * (v1 + eps)) AS ll FROM d, c, g),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, label) AS rk FROM s)
SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM r WHERE rk = 1""")
def gnb_embeddings_2d(spark, sf):
    d = _emb2(spark, sf)
    fitted = learners("classification")["Gaussian NB"].fit(d, ["e0", "e1"], "label")
    return fitted.transform(d).select("vec_id", "prediction")


@register("gnb_text_label", """WITH d AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1,
  concat('class ', CAST(label AS VARCHAR)) AS label FROM embeddings),
g AS (SELECT 1e-9 * greatest(var_pop(e0), var_pop(e1)) AS eps, count(*) AS n FROM d),
c AS (SELECT label, count(*) AS nc, avg(e0) AS m0, avg(e1) AS m1, var_pop(e0) AS v0, var_pop(e1) AS v1 FROM d GROUP BY label),
s AS (SELECT d.vec_id, c.label, ln(nc) - ln(n)
        - 0.5 * ln(2 * pi() * (v0 + eps)) - (e0 - m0) * (e0 - m0) / (2 * (v0 + eps))
        - 0.5 * ln(2 * pi() * (v1 + eps)) - (e1 - m1) * (e1 - m1) / (2 * (v1 + eps)) AS ll FROM d, c, g),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, label) AS rk FROM s)
SELECT vec_id, label AS prediction FROM r WHERE rk = 1""")
def gnb_text_label(spark, sf):
    """A text target: encoded for the fit, predictions are labels again."""
    d = _emb2(spark, sf).withColumn("label", F.concat(F.lit("class "), F.col("label").cast("int").cast("string")))
    fitted = learners("classification")["Gaussian NB"].fit(d, ["e0", "e1"], "label")
    return fitted.transform(d).select("vec_id", "prediction")


@register("gnb_embeddings", """WITH d AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
g AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(x) AS v FROM d GROUP BY j)),
n AS (SELECT label, count(*) AS nc, (SELECT count(*) FROM embeddings) AS n FROM embeddings GROUP BY label),
c AS (SELECT label, j, avg(x) AS m, var_pop(x) AS v FROM d GROUP BY label, j),
s AS (SELECT d.vec_id, n.label, ln(nc) - ln(n) + sum(-0.5 * ln(2 * pi() * (v + eps)) - (x - m) * (x - m) / (2 * (v + eps))) AS ll
      FROM d JOIN c USING (j), g, n WHERE n.label = c.label GROUP BY d.vec_id, n.label, nc, n),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, label) AS rk FROM s)
SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM r WHERE rk = 1""")
def gnb_embeddings(spark, sf):
    """All 64 dimensions."""
    e = table(spark, sf, "embeddings")
    feats = [f"e{j}" for j in range(64)]
    d = e.select("vec_id", *[F.col("embedding")[j].cast("double").alias(f) for j, f in enumerate(feats)], F.col("label").cast("double").alias("label"))
    return learners("classification")["Gaussian NB"].fit(d, feats, "label").transform(d).select("vec_id", "prediction")


@register("leaderboard_text_target")
def leaderboard_text_target(spark, sf):
    d = f_class(spark, sf).withColumn("y", F.when(F.col("y") == 1, "yes").otherwise("no"))
    board, _ = fit_and_rank(d, FEATS, "y", "classification", KEY, ["Logistic Regression", "Decision Tree", "Gaussian NB"],
                            validation="stratified_kfold")
    return board.drop("fit_time")


@register("knn_embeddings", """WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label,
  substr(md5(concat('7:', CAST(vec_id AS VARCHAR))), 1, 4) < '4000' AS is_test FROM embeddings),
p AS (SELECT te.vec_id AS q, tr.vec_id AS r, tr.label, list_distance(te.v, tr.v) AS dist
      FROM (SELECT * FROM d WHERE is_test) te, (SELECT * FROM d WHERE NOT is_test) tr),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS rk FROM p),
v AS (SELECT q, label, count(*) AS n FROM k WHERE rk <= 5 GROUP BY q, label),
b AS (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY n DESC, label) AS o FROM v)
SELECT q AS vec_id, CAST(label AS DOUBLE) AS prediction FROM b WHERE o = 1""")
def knn_embeddings(spark, sf):
    e = hash_split(table(spark, sf, "embeddings"), ["vec_id"], 25, 7)
    train, test = e.where(~F.col("is_test")), e.where(F.col("is_test"))
    fitted = KNNLearner("classification", k=5, key_cols=["vec_id"]).fit(train, ["embedding"], "label")
    return fitted.transform(test).select("vec_id", "prediction")


def _fclass_parts(spark, sf):
    d = hash_split(f_class(spark, sf), KEY, 25, 7)
    return d.where(~F.col("is_test")).drop("is_test"), d.where(F.col("is_test")).drop("is_test")


def _model_metrics(name, label="y"):
    def q(spark, sf):
        train, test = _fclass_parts(spark, sf)
        learner = learners("classification")[name]
        if hasattr(learner, "key_cols"):
            learner.key_cols = KEY
        fitted = learner.fit(train, FEATS, label)
        m = score(fitted.transform(test), label, "classification")
        return spark.createDataFrame([(name, *[None if m[k] is None else round(float(m[k]), 4) for k in m])],
                                     "model string, " + ", ".join(f"{k} double" for k in m))
    return q


for _key, _name in [("logreg", "Logistic Regression"), ("tree", "Decision Tree"), ("forest", "Random Forest"),
                    ("gbt", "Gradient Boosting"), ("adaboost", "AdaBoost"), ("xgb_like", "XGB"),
                    ("linear_svc", "Linear SVC"), ("knn_fclass", "KNN"), ("gaussian_nb", "Gaussian NB")]:
    register(_key)(_model_metrics(_name))

register("svc_rbf")(_model_metrics("SVC"))
register("svc_rbf_multiclass")(_model_metrics("SVC", "y3"))
register("gbt_multiclass")(_model_metrics("Gradient Boosting", "y3"))
register("logreg_multiclass")(_model_metrics("Logistic Regression", "y3"))


@register("adaboost_regression")
def adaboost_regression(spark, sf):
    d = hash_split(_part_xy(spark, sf), ["p_partkey"], 25, 7)
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    fitted = AdaBoost("regression").fit(train, ["x"], "p_retailprice")
    return round_doubles(E.regression_metrics(fitted.transform(test), "p_retailprice", "prediction"), 4)


@register("leaderboard_classification")
def leaderboard_classification(spark, sf):
    board, _ = fit_and_rank(f_class(spark, sf), FEATS, "y", "classification", KEY,
                            ["Logistic Regression", "Decision Tree", "Gaussian NB", "Linear SVC"])
    return board.drop("fit_time")


@register("leaderboard_regression")
def leaderboard_regression(spark, sf):
    board, _ = fit_and_rank(_part_xy(spark, sf), ["x"], "p_retailprice", "regression", ["p_partkey"],
                            ["Linear Regression", "Decision Tree", "Gradient Boosting", "KNN"])
    return board.drop("fit_time")


@register("leaderboard_cv")
def leaderboard_cv(spark, sf):
    board, _ = fit_and_rank(f_class(spark, sf), FEATS, "y", "classification", KEY,
                            ["Logistic Regression", "Gaussian NB"], validation="stratified_kfold")
    return board.drop("fit_time")


@register("predict_classification")
def predict_classification(spark, sf):
    train, test = _fclass_parts(spark, sf)
    fitted = learners("classification")["Logistic Regression"].fit(train, FEATS, "y")
    return round_doubles(predict(fitted, test).select(*KEY, "y", "Predictions", "Probability"), 6)


@register("predict_regression")
def predict_regression(spark, sf):
    d = _part_xy(spark, sf)
    fitted = learners("regression")["Decision Tree"].fit(d, ["x"], "p_retailprice")
    return round_doubles(predict(fitted, d).select("p_partkey", "p_retailprice", "Predictions"), 6)


@register("prediction_histogram")
def prediction_histogram_q(spark, sf):
    train, test = _fclass_parts(spark, sf)
    fitted = learners("classification")["Decision Tree"].fit(train, FEATS, "y3")
    return prediction_histogram(predict(fitted, test), "classification")


@register("cv_scores")
def cv_scores(spark, sf):
    folds = cross_validate(learners("classification")["Logistic Regression"], f_class(spark, sf), FEATS, "y",
                           "classification", KEY, 5, "kfold")
    rows = [(f["fold"], *[None if f[k] is None else round(float(f[k]), 4) for k in
                          ("accuracy", "roc_auc", "precision_weighted", "recall_weighted", "f1_weighted")])
            for f in folds]
    return spark.createDataFrame(rows, "fold int, accuracy double, roc_auc double, precision_weighted double, "
                                       "recall_weighted double, f1_weighted double")


@register("importance_tree")
def importance_tree(spark, sf):
    train, _ = _fclass_parts(spark, sf)
    fitted = learners("classification")["Random Forest"].fit(train, FEATS, "y")
    return round_doubles(E.feature_importance(fitted.last_stage, FEATS, spark), 6)


@register("importance_linear")
def importance_linear(spark, sf):
    train, _ = _fclass_parts(spark, sf)
    fitted = learners("classification")["Logistic Regression"].fit(train, FEATS, "y")
    return round_doubles(E.feature_importance(fitted.last_stage, FEATS, spark), 6)


@register("smote", with_fixtures("""SELECT y, (SELECT max(n) FROM (SELECT count(*) AS n FROM f_class GROUP BY y)) AS "count"
FROM f_class GROUP BY y""", "f_class"))
def smote_counts(spark, sf):
    from tabloom.operators.resample import smote
    out = smote(f_class(spark, sf), FEATS, "y", KEY)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("count"))


@register("smote_rows")
def smote_rows(spark, sf):
    from tabloom.operators.resample import smote
    return round_doubles(smote(f_class(spark, sf), FEATS, "y", KEY), 6)


@register("smoteenn")
def smoteenn_counts(spark, sf):
    from tabloom.operators.resample import smoteenn
    out = smoteenn(f_class(spark, sf), FEATS, "y", KEY)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("count"))


@register("leaderboard_smote")
def leaderboard_smote(spark, sf):
    board, _ = fit_and_rank(f_class(spark, sf), FEATS, "y", "classification", KEY,
                            ["Logistic Regression", "Gaussian NB"], resample="SMOTE")
    return board.drop("fit_time")
