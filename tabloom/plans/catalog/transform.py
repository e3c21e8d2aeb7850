"""Transform, encoder, outlier and imputer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.exprs import round_doubles
from tabloom.operators import profile as P
from tabloom.operators import transform as TR
from tabloom.plans.catalog import register
from tabloom.sources.tables import f_null, table, with_fixtures

R = 6


@register("label_encode", """SELECT o_orderkey, o_orderpriority,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_label FROM orders""")
def label_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    out, _ = TR.fit_transform(o, "label_encode", ["o_orderpriority"], suffix="_label")
    return out


@register("label_encode_names", """SELECT c_custkey, c_name,
  CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name_label FROM customer""")
def label_encode_names(spark, sf):
    """One code per customer name: a joined table, not a list in the plan."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return TR.apply_label_encode(c, ["c_name"], TR.fit_label_encode(c, ["c_name"], plan_limit=100), "_label")


@register("label_decode", "SELECT o_orderkey, o_orderpriority FROM orders")
def label_decode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    params = TR.fit_label_encode(o, ["o_orderpriority"])
    enc = TR.apply_label_encode(o, ["o_orderpriority"], params)
    return TR.apply_label_decode(enc, ["o_orderpriority"], params)


@register("one_hot", """SELECT o_orderkey, CAST(coalesce(o_orderstatus = 'F', false) AS INTEGER) AS o_orderstatus_F,
  CAST(coalesce(o_orderstatus = 'O', false) AS INTEGER) AS o_orderstatus_O,
  CAST(coalesce(o_orderstatus = 'P', false) AS INTEGER) AS o_orderstatus_P FROM orders""")
def one_hot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    out, _ = TR.fit_transform(o, "one_hot", ["o_orderstatus"])
    return out


@register("one_hot_reverse", "SELECT o_orderkey, o_orderstatus FROM orders")
def one_hot_reverse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    params = TR.fit_one_hot(o, ["o_orderstatus"])
    enc = TR.apply_one_hot(o, ["o_orderstatus"], params)
    return TR.apply_reverse_one_hot(enc, ["o_orderstatus"], params)


@register("log", "SELECT event_id, value, round(ln(1 + value), 9) AS value_log FROM events")
def log(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    out, _ = TR.fit_transform(e, "log", ["value"], suffix="_log")
    return out.withColumn("value_log", F.round("value_log", 9))


@register("log_inverse", "SELECT event_id, round(exp(ln(1 + value)) - 1, 6) AS value FROM events")
def log_inverse(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    logged = TR.apply_log(e, ["value"])
    return round_doubles(TR.apply_log_inverse(logged, ["value"]), 6)


@register("sqrt", "SELECT event_id, round(sqrt(value), 9) AS value_sqrt FROM events")
def sqrt(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    out, _ = TR.fit_transform(e, "sqrt", ["value"], suffix="_sqrt")
    return out.select("event_id", F.round("value_sqrt", 9).alias("value_sqrt"))


def _llf_sql(grid: str, name: str) -> str:
    bc = "CASE WHEN abs(lam) < 1e-12 THEN ln(v) ELSE (pow(v, lam) - 1) / lam END"
    return f"""{name} AS (SELECT lam, (lam - 1) * sl - n / 2 * ln(var_pop({bc})) AS llf
      FROM {grid}, e, s GROUP BY lam, sl, n)"""


BOX_COX_SQL = f"""WITH e AS (SELECT value AS v FROM events WHERE value IS NOT NULL),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(ln(v)) AS sl FROM e),
g1 AS (SELECT round(-2.0 + i * CAST(0.1 AS DOUBLE), 10) AS lam FROM range(41) t(i)),
{_llf_sql("g1", "l1")},
b1 AS (SELECT lam FROM l1 ORDER BY llf DESC, lam LIMIT 1),
g2 AS (SELECT b1.lam + k * (CAST(0.1 AS DOUBLE) / 10) AS lam FROM b1, range(-10, 11) t(k)),
{_llf_sql("g2", "l2")},
b2 AS (SELECT lam FROM l2 ORDER BY llf DESC, lam LIMIT 1),
g3 AS (SELECT b2.lam + k * (CAST(0.1 AS DOUBLE) / 10 / 10) AS lam FROM b2, range(-10, 11) t(k)),
{_llf_sql("g3", "l3")},
b3 AS (SELECT lam FROM l3 ORDER BY llf DESC, lam LIMIT 1)
SELECT event_id, round(CASE WHEN abs(lam) < 1e-12 THEN ln(value) ELSE (pow(value, lam) - 1) / lam END, 6) AS value_boxcox,
  round(lam, 9) AS lambda
FROM events, b3"""


@register("box_cox", BOX_COX_SQL)
def box_cox(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    out, params = TR.fit_transform(e, "box_cox", ["value"], suffix="_boxcox")
    return out.select("event_id", F.round("value_boxcox", 6).alias("value_boxcox"),
                      F.round(F.lit(params["lambda"]["value"]), 9).alias("lambda"))


IQR_CTE = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""


@register("iqr_bounds", IQR_CTE + f"""SELECT 'value' AS "column", round(q1, {R}) AS q1, round(q3, {R}) AS q3,
  round(lo, {R}) AS lower, round(hi, {R}) AS upper FROM b""")
def iqr_bounds(spark, sf):
    e = table(spark, sf, "events")
    params = TR.fit_iqr_bounds(e, ["value"])
    q = TR.quantile_table(e, ["value"], [0.25, 0.75])
    lo, hi = params["bounds"]["value"]
    out = q.select(F.lit("value").alias("column"), F.col("value")[0].alias("q1"), F.col("value")[1].alias("q3"),
                   F.lit(lo).alias("lower"), F.lit(hi).alias("upper"))
    return round_doubles(out, R)


@register("remove_outliers", IQR_CTE + "SELECT event_id, value FROM events, b WHERE value >= lo AND value <= hi")
def remove_outliers(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    out, _ = TR.fit_transform(e, "remove_outliers", ["value"])
    return out


@register("outlier_rate", IQR_CTE + f"""SELECT round(avg(CASE WHEN value < lo OR value > hi THEN 1.0 ELSE 0.0 END) * 100, {R}) AS outlier_pct,
  count(*) FILTER (WHERE value < lo OR value > hi) AS n_outliers, count(*) AS n_rows FROM events, b""")
def outlier_rate(spark, sf):
    e = table(spark, sf, "events")
    b = TR.fit_iqr_bounds(e, ["value"])["bounds"]
    return round_doubles(P.outlier_rate(e, {"value": tuple(b["value"])}), R)


@register("impute_outliers_mean", IQR_CTE + f""", m AS (SELECT avg(value) AS fill FROM events, b WHERE value >= lo AND value <= hi)
SELECT event_id, round(CASE WHEN value IS NULL OR value < lo OR value > hi THEN fill ELSE value END, {R}) AS value_mean_outliers
FROM events, b, m""")
def impute_outliers_mean(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    out, _ = TR.fit_transform(e, "mean_impute_outliers", ["value"], suffix="_mean_outliers")
    return round_doubles(out.select("event_id", "value_mean_outliers"), R)


@register("impute_outliers_median", IQR_CTE + f""", m AS (SELECT quantile_cont(value, 0.5) AS fill FROM events, b WHERE value >= lo AND value <= hi)
SELECT event_id, round(CASE WHEN value IS NULL OR value < lo OR value > hi THEN fill ELSE value END, {R}) AS value_median_outliers
FROM events, b, m""")
def impute_outliers_median(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    out, _ = TR.fit_transform(e, "median_impute_outliers", ["value"], suffix="_median_outliers")
    return round_doubles(out.select("event_id", "value_median_outliers"), R)


@register("impute_mean", with_fixtures(f"""SELECT c_custkey,
  round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM f_null)), {R}) AS c_acctbal_mean_imputed FROM f_null""", "f_null"))
def impute_mean(spark, sf):
    d = f_null(spark, sf)
    out, _ = TR.fit_transform(d, "impute_mean", ["c_acctbal"], suffix="_mean_imputed")
    return round_doubles(out.select("c_custkey", "c_acctbal_mean_imputed"), R)


@register("impute_median", with_fixtures(f"""SELECT c_custkey,
  round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM f_null)), {R}) AS c_acctbal_median_imputed
FROM f_null""", "f_null"))
def impute_median(spark, sf):
    d = f_null(spark, sf)
    out, _ = TR.fit_transform(d, "impute_median", ["c_acctbal"], suffix="_median_imputed")
    return round_doubles(out.select("c_custkey", "c_acctbal_median_imputed"), R)


@register("impute_mode", with_fixtures("""SELECT c_custkey,
  coalesce(c_mktsegment, (SELECT v FROM (SELECT c_mktsegment AS v, count(*) AS n FROM f_null
    WHERE c_mktsegment IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) AS c_mktsegment_mode_imputed
FROM f_null""", "f_null"))
def impute_mode(spark, sf):
    d = f_null(spark, sf)
    out, _ = TR.fit_transform(d, "impute_mode", ["c_mktsegment"], suffix="_mode_imputed")
    return out.select("c_custkey", "c_mktsegment_mode_imputed")


@register("impute_zero", with_fixtures(f"""SELECT c_custkey, round(coalesce(c_acctbal, 0), {R}) AS c_acctbal_zero_imputed
FROM f_null""", "f_null"))
def impute_zero(spark, sf):
    d = f_null(spark, sf)
    out, _ = TR.fit_transform(d, "impute_zero", ["c_acctbal"], suffix="_zero_imputed")
    return round_doubles(out.select("c_custkey", "c_acctbal_zero_imputed"), R)
