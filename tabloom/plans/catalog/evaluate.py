"""Evaluation queries on rule-made predictions (Q1-Q10, Q12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.exprs import NORM_PPF_SQL, round_doubles
from tabloom.operators import evaluate as E
from tabloom.plans.catalog import register
from tabloom.sources.tables import f_class, f_scored, with_fixtures

D = 9


def _scored_pred(spark, sf):
    return f_scored(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def _multi_pred(spark, sf):
    # a three-class truth and a rule that never predicts class 1
    return f_class(spark, sf).withColumn("pred3", F.when(F.col("x1") > 0.5, 2).otherwise(0))


def _class_metrics_sql(src: str, y: str, pred_expr: str, pos: int | None) -> str:
    auc = (f"""(SELECT (count(*) FILTER (WHERE y = {pos} AND pred = {pos}) / count(*) FILTER (WHERE y = {pos})
          + count(*) FILTER (WHERE y <> {pos} AND pred <> {pos}) / count(*) FILTER (WHERE y <> {pos})) / 2 FROM d)"""
           if pos is not None else
           """(SELECT avg(a) FROM (SELECT (count(*) FILTER (WHERE y = c AND pred = c) / count(*) FILTER (WHERE y = c)
          + count(*) FILTER (WHERE y <> c AND pred <> c) / count(*) FILTER (WHERE y <> c)) / 2 AS a
          FROM d, (SELECT DISTINCT y AS c FROM d) k GROUP BY c))""")
    return f"""d AS (SELECT {y} AS y, {pred_expr} AS pred FROM {src}),
lab AS (SELECT DISTINCT pred AS l FROM d),
per AS (SELECT l, count(*) FILTER (WHERE y = l) AS support, count(*) FILTER (WHERE pred = l) AS npred,
          count(*) FILTER (WHERE y = l AND pred = l) AS tp FROM lab, d GROUP BY l),
m AS (SELECT l, support, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS p,
        CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT round((SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) FROM d), {D}) AS accuracy,
  round(sum(p * support) / sum(support), {D}) AS precision_weighted,
  round(sum(r * support) / sum(support), {D}) AS recall_weighted,
  round(sum(f1 * support) / sum(support), {D}) AS f1_weighted,
  round({auc}, {D}) AS roc_auc
FROM f"""


def _cte(sql_tail: str, fixture: str) -> str:
    s = with_fixtures(sql_tail, fixture)
    head, rest = s.split("\n)\n", 1)
    return head + "\n),\n" + rest


@register("metrics_classification", _cte(_class_metrics_sql(
    "f_scored", "y", "CASE WHEN score >= 0.5 THEN 1 ELSE 0 END", 1), "f_scored"))
def metrics_classification(spark, sf):
    return round_doubles(E.classification_metrics(_scored_pred(spark, sf), "y", "pred"), D)


@register("metrics_multiclass", _cte(_class_metrics_sql(
    "f_class", "y3", "CASE WHEN x1 > 0.5 THEN 2 ELSE 0 END", None), "f_class"))
def metrics_multiclass(spark, sf):
    return round_doubles(E.classification_metrics(_multi_pred(spark, sf), "y3", "pred3"), D)


@register("metrics_regression", with_fixtures(f"""SELECT round(avg(abs(actual - predicted)), {D}) AS mae,
  round(avg((actual - predicted) * (actual - predicted)), {D - 3}) AS mse,
  round(sqrt(avg((actual - predicted) * (actual - predicted))), {D}) AS rmse,
  round(1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual), {D}) AS r2,
  round(1 - var_pop(actual - predicted) / var_pop(actual), {D}) AS explained_variance FROM f_scored""", "f_scored"))
def metrics_regression(spark, sf):
    m = E.regression_metrics(f_scored(spark, sf), "actual", "predicted")
    return m.select(F.round("mae", D).alias("mae"), F.round("mse", D - 3).alias("mse"), F.round("rmse", D).alias("rmse"),
                    F.round("r2", D).alias("r2"), F.round("explained_variance", D).alias("explained_variance"))


SCORE_CTE = """s AS (SELECT score, CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS pos,
        CAST(count(*) FILTER (WHERE y <> 1) AS BIGINT) AS neg FROM f_scored GROUP BY score),
t AS (SELECT CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM s)
"""


@register("auc", _cte(SCORE_CTE + f""", c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT round(sum(CAST(pos AS DOUBLE) * (CAST(below AS DOUBLE) + 0.5 * neg)) / (P * N), {D}) AS auc FROM c, t GROUP BY P, N""",
                      "f_scored"))
def auc(spark, sf):
    v = E.roc_auc(f_scored(spark, sf), "y", "score")
    return spark.createDataFrame([(round(v, D),)], "auc double")


@register("auc_multiclass", with_fixtures(f"""WITH d AS (SELECT y3 AS y, CASE WHEN x1 > 0.5 THEN 2 ELSE 0 END AS pred FROM f_class)
SELECT round(avg(a), {D}) AS auc_multiclass FROM (
  SELECT (count(*) FILTER (WHERE y = c AND pred = c) / count(*) FILTER (WHERE y = c)
        + count(*) FILTER (WHERE y <> c AND pred <> c) / count(*) FILTER (WHERE y <> c)) / 2 AS a
  FROM d, (SELECT DISTINCT y AS c FROM d) k GROUP BY c)""", "f_class").replace("\n)\nWITH d AS", "\n),\nd AS"))
def auc_multiclass(spark, sf):
    counts = {(r["actual"], r["predicted"]): r["count"]
              for r in E.confusion_matrix(_multi_pred(spark, sf), "y3", "pred3").collect()}
    return spark.createDataFrame([(round(E.auc_multiclass_hard(counts), D),)], "auc_multiclass double")


@register("roc_curve", _cte(SCORE_CTE + f""", c AS (SELECT score,
  sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM s)
SELECT round(score, {D}) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  round(tp / P, {D}) AS tpr, round(fp / N, {D}) AS fpr FROM c, t""", "f_scored"))
def roc_curve(spark, sf):
    return round_doubles(E.roc_curve(f_scored(spark, sf), "y", "score"), D)


@register("pr_curve", _cte(SCORE_CTE + f""", c AS (SELECT score,
  sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM s)
SELECT round(score, {D}) AS threshold, round(tp / (tp + fp), {D}) AS precision, round(tp / P, {D}) AS recall FROM c, t""",
                           "f_scored"))
def pr_curve(spark, sf):
    return round_doubles(E.pr_curve(f_scored(spark, sf), "y", "score"), D)


@register("ks", _cte(SCORE_CTE + f""", c AS (SELECT score,
  abs(sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) / (SELECT N FROM t)
    - sum(pos) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) / (SELECT P FROM t)) AS gap FROM s)
SELECT round(max(gap), {D}) AS ks, round(min(score) FILTER (WHERE gap = (SELECT max(gap) FROM c)), {D}) AS threshold FROM c""",
                     "f_scored"))
def ks(spark, sf):
    return round_doubles(E.ks_statistic(f_scored(spark, sf), "y", "score"), D)


@register("confusion", with_fixtures("""SELECT y AS actual, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted,
  count(*) AS "count" FROM f_scored GROUP BY 1, 2""", "f_scored"))
def confusion(spark, sf):
    return E.confusion_matrix(_scored_pred(spark, sf), "y", "pred")


@register("qq_points", _cte(f"""r AS (SELECT o_orderkey, actual - predicted AS e FROM f_scored),
st AS (SELECT count(e) AS n, avg(e) AS m, stddev_pop(e) AS s FROM r),
k AS (SELECT o_orderkey, e, row_number() OVER (ORDER BY e, o_orderkey) AS i FROM r)
SELECT o_orderkey, i, round({NORM_PPF_SQL.format(p='(i / (n + 1))')}, 6) AS theoretical,
  round((e - m) / s, 6) AS sample FROM k, st""", "f_scored"))
def qq_points(spark, sf):
    d = f_scored(spark, sf).withColumn("e", F.col("actual") - F.col("predicted"))
    return round_doubles(E.qq_points(d, "e", "o_orderkey"), 6)


@register("pred_vs_actual_fit", _cte("""st AS (SELECT avg(actual) AS m, stddev_pop(actual) AS s FROM f_scored),
u AS (SELECT (actual - m) / s AS u, predicted AS v FROM f_scored, st),
g AS (SELECT count(*) AS a00, sum(u) AS a01, sum(u * u) AS a02, sum(u * u * u) AS a12, sum(u * u * u * u) AS a22,
        sum(v) AS b0, sum(u * v) AS b1, sum(u * u * v) AS b2 FROM u),
det AS (SELECT *, a00 * (a02 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a02 * a02) AS dt FROM g)
SELECT round((b0 * (a02 * a22 - a12 * a12) - a01 * (b1 * a22 - a12 * b2) + a02 * (b1 * a12 - a02 * b2)) / dt, 3) AS c0,
  round((a00 * (b1 * a22 - b2 * a12) - b0 * (a01 * a22 - a12 * a02) + a02 * (a01 * b2 - b1 * a02)) / dt, 3) AS c1,
  round((a00 * (a02 * b2 - a12 * b1) - a01 * (a01 * b2 - b1 * a02) + b0 * (a01 * a12 - a02 * a02)) / dt, 3) AS c2
FROM det""", "f_scored"))
def pred_vs_actual_fit(spark, sf):
    fit = E.poly_fit(f_scored(spark, sf), "actual", "predicted", 2)
    c = fit["coef"]
    return spark.createDataFrame([(round(c[0], 3), round(c[1], 3), round(c[2], 3))], "c0 double, c1 double, c2 double")


@register("choose_scoring", with_fixtures("""SELECT 'y' AS target, CASE WHEN count(DISTINCT y) <= 2 THEN 'roc_auc' ELSE 'f1_weighted' END AS scoring FROM f_class
UNION ALL SELECT 'y3', CASE WHEN count(DISTINCT y3) <= 2 THEN 'roc_auc' ELSE 'f1_weighted' END FROM f_class""", "f_class"))
def choose_scoring(spark, sf):
    d = f_class(spark, sf)
    return spark.createDataFrame([(t, E.choose_scoring(d, t)) for t in ("y", "y3")], "target string, scoring string")


def _three_class(spark, sf):
    # a rule-made probability for each of the three classes of y3 (rows sum to one)
    d = f_class(spark, sf)
    a, b, c = F.col("x1") + 0.1, F.col("x2") + 0.1, F.col("x3") + 0.1
    t = a + b + c
    return d.select("y3", (a / t).alias("p0"), (b / t).alias("p1"), (c / t).alias("p2"))


_OVR_SQL = """q AS (SELECT y3, x1 + 0.1 AS a, x2 + 0.1 AS b, x3 + 0.1 AS c FROM f_class),
p AS (SELECT y3, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM q),
l AS (SELECT '0' AS cls, p0 AS s, CASE WHEN y3 = 0 THEN 1 ELSE 0 END AS t FROM p
      UNION ALL SELECT '1', p1, CASE WHEN y3 = 1 THEN 1 ELSE 0 END FROM p
      UNION ALL SELECT '2', p2, CASE WHEN y3 = 2 THEN 1 ELSE 0 END FROM p),
b AS (SELECT * FROM l UNION ALL SELECT 'micro', s, t FROM l),
sc AS (SELECT cls, s AS score, sum(t) AS pos, sum(1 - t) AS neg FROM b GROUP BY cls, s),
tot AS (SELECT cls, CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM sc GROUP BY cls),
c AS (SELECT cls, score, sum(pos) OVER (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
        sum(neg) OVER (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM sc)
"""


@register("roc_curve_ovr", _cte(_OVR_SQL + f"""SELECT c.cls AS curve, round(score, {D}) AS threshold,
  round(tp / P, {D}) AS tpr, round(fp / N, {D}) AS fpr FROM c JOIN tot ON c.cls = tot.cls""", "f_class"))
def roc_curve_ovr(spark, sf):
    d = _three_class(spark, sf)
    return round_doubles(E.curves_ovr(d, "y3", {0: "p0", 1: "p1", 2: "p2"}, "roc"), D)


@register("pr_curve_ovr", _cte(_OVR_SQL + f"""SELECT c.cls AS curve, round(score, {D}) AS threshold,
  round(tp / (tp + fp), {D}) AS precision, round(tp / P, {D}) AS recall FROM c JOIN tot ON c.cls = tot.cls""",
                              "f_class"))
def pr_curve_ovr(spark, sf):
    d = _three_class(spark, sf)
    return round_doubles(E.curves_ovr(d, "y3", {0: "p0", 1: "p1", 2: "p2"}, "pr"), D)
