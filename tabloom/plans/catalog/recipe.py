"""Recipe queries (R1-R7, C10): fit on the train part of F-null, replay on the test part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.exprs import round_doubles
from tabloom.operators.split import hash_split
from tabloom.plans.catalog import register
from tabloom.plans.recipe import Recipe
from tabloom.sources.tables import f_null, with_fixtures

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _parts(spark, sf):
    d = hash_split(f_null(spark, sf), ["c_custkey"], 25, 7)
    return d.where(~F.col("is_test")).drop("is_test"), d.where(F.col("is_test")).drop("is_test")


def _recipe():
    return (Recipe().stage("impute_median", ["c_acctbal"]).stage("impute_mode", ["c_mktsegment"])
            .stage("one_hot", ["c_mktsegment"]).stage("label_encode", ["c_nationkey"]))


def _sql(part: str, impute_median: bool = True) -> str:
    cond = ">=" if part == "train" else "<"
    acct = "round(coalesce(c_acctbal, med), 6)" if impute_median else "round(c_acctbal, 6)"
    dummies = ",\n  ".join(f"CAST(coalesce(seg = '{s}', false) AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS)
    return with_fixtures(f"""t AS (SELECT * FROM f_null WHERE substr(md5(concat('7:', CAST(c_custkey AS VARCHAR))), 1, 4) >= '4000'),
x AS (SELECT * FROM f_null WHERE substr(md5(concat('7:', CAST(c_custkey AS VARCHAR))), 1, 4) {cond} '4000'),
p AS (SELECT quantile_cont(c_acctbal, 0.5) AS med FROM t),
m AS (SELECT v AS mode FROM (SELECT c_mktsegment AS v, count(*) AS n FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1)
      ORDER BY n DESC, v LIMIT 1),
nk AS (SELECT c_nationkey AS k, CAST(row_number() OVER (ORDER BY c_nationkey) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT c_nationkey FROM t WHERE c_nationkey IS NOT NULL)),
s AS (SELECT c_custkey, {acct} AS c_acctbal, coalesce(c_mktsegment, mode) AS seg, c_nationkey FROM x, p, m)
SELECT c_custkey, c_acctbal, nk.code AS c_nationkey,
  {dummies}
FROM s LEFT JOIN nk ON s.c_nationkey = nk.k""", "f_null")


def _fix_with(sql: str) -> str:
    # with_fixtures puts the fixture CTE first; the remaining CTEs follow after a comma
    head, rest = sql.split("\n)\n", 1)
    return head + "\n),\n" + rest


@register("recipe_apply", _fix_with(_sql("train")))
def recipe_apply(spark, sf):
    train, _ = _parts(spark, sf)
    fitted = _recipe().fit(train)
    return round_doubles(fitted.transform(train), 6)


@register("recipe_replay", _fix_with(_sql("test")))
def recipe_replay(spark, sf):
    train, test = _parts(spark, sf)
    fitted = _recipe().fit(train)
    return round_doubles(fitted.transform(test), 6)


@register("recipe_remove_step", _fix_with(_sql("train", impute_median=False)))
def recipe_remove_step(spark, sf):
    train, _ = _parts(spark, sf)
    fitted = _recipe().fit(train)
    return round_doubles(fitted.remove_steps([0], source=train).transform(train), 6)


@register("recipe_steps")
def recipe_steps(spark, sf):
    train, _ = _parts(spark, sf)
    return _recipe().fit(train).list_steps(spark)


@register("recipe_view_transformed",
          _fix_with(_sql("train")).replace("SELECT c_custkey, c_acctbal, nk.code", "SELECT c_acctbal, nk.code"))
def recipe_view_transformed(spark, sf):
    train, _ = _parts(spark, sf)
    return round_doubles(_recipe().fit(train).view_transformed(train), 6)


@register("recipe_preview", with_fixtures("""SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey,
  round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM f_null)), 6) AS c_acctbal_median_imputed
FROM f_null ORDER BY c_custkey LIMIT 20""", "f_null"))
def recipe_preview(spark, sf):
    d = f_null(spark, sf)
    return round_doubles(Recipe().preview(d, "impute_median", ["c_acctbal"], 20, ["c_custkey"]), 6)


@register("recipe_inverse", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def recipe_inverse(spark, sf):
    from tabloom.sources.tables import table
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    fitted = Recipe().stage("label_encode", ["o_orderpriority"]).stage("one_hot", ["o_orderstatus"]).fit(o)
    return fitted.inverse(fitted.transform(o)).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@register("stream_recipe_replay", _fix_with(_sql("test")))
def stream_recipe_replay(spark, sf):
    """The test part arrives as files; the fitted recipe is replayed on them as a stream."""
    from tabloom.session import scratch_path
    from tabloom.streaming.score import replay_folder
    train, test = _parts(spark, sf)
    fitted = _recipe().fit(train)
    fitted.features = ["c_custkey", "c_acctbal", "c_nationkey"] + [f"c_mktsegment_{s}" for s in SEGMENTS]
    src, sink, ck = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    test.write.parquet(src)
    replay_folder(spark, src, test.schema, fitted, sink, ck)
    return round_doubles(spark.read.parquet(sink), 6)
