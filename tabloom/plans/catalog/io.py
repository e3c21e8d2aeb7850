"""Source and sink round trips (S1-S3, S5-S9).  Files go to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.exprs import round_doubles
from tabloom.operators.models import learners, predict
from tabloom.operators.split import hash_split
from tabloom.plans.catalog import register
from tabloom.session import scratch_path
from tabloom.sources import files as S
from tabloom.sources import store as ST
from tabloom.sources.tables import f_class, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATS = ["x1", "x2", "x3"]


@register("csv_roundtrip", "SELECT * FROM customer")
def csv_roundtrip(spark, sf):
    c = table(spark, sf, "customer")
    path = scratch_path(spark, "csv")
    S.write_csv(c, path)
    return S.read_csv(spark, path, c.schema)


@register("csv_text_roundtrip", """SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS even,
  CASE WHEN doc_id % 3 = 0 THEN 'True' ELSE 'false' END = 'True' AS third, '2020-01' AS month
FROM documents""")
def csv_text_roundtrip(spark, sf):
    """Whole texts with quotes and line breaks; Yes/No and dates stay text, true/false become boolean."""
    path = scratch_path(spark, "csv")
    even = F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise("No")
    third = F.when(F.col("doc_id") % 3 == 0, "True").otherwise("false")
    S.write_csv(table(spark, sf, "documents").select("doc_id", "text", even.alias("even"), third.alias("third"),
                                                     F.lit("2020-01").alias("month")), path)
    return S.read_csv(spark, path)


@register("csv_infer", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
FROM customer""")
def csv_infer(spark, sf):
    path = scratch_path(spark, "csv")
    S.write_csv(table(spark, sf, "customer"), path)
    return S.read_csv(spark, path)


@register("csv_na_tokens", """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS c_name,
  CAST(c_nationkey AS BIGINT) AS c_nationkey,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def csv_na_tokens(spark, sf):
    c = table(spark, sf, "customer")
    dirty = c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 11 == 0, F.lit("null")).otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit("?")).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("NA")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    path = scratch_path(spark, "csv")
    S.write_csv(dirty, path)
    return S.read_csv(spark, path, na_tokens=S.NA_TOKENS + ["?"])


@register("tsv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def tsv_roundtrip(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    path = scratch_path(spark, "tsv")
    S.write_csv(o, path, sep="\t")
    return S.read_table(spark, path, o.schema)


@register("url_read", "SELECT * FROM nation")
def url_read(spark, sf):
    n = table(spark, sf, "nation")
    path = scratch_path(spark, "url")
    S.write_csv(n, path)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return S.read_url(spark, uri, n.schema)


@register("dataset_roundtrip", "SELECT * FROM part")
def dataset_roundtrip(spark, sf):
    base = scratch_path(spark, "datasets")
    S.save_dataset(table(spark, sf, "part"), "part_ds", "tabloom_rt", base)
    names = [r["name"] for r in S.list_datasets(spark, "tabloom_rt").collect()]
    if "part_ds" not in names:
        raise RuntimeError("saved dataset not listed")
    return S.load_dataset(spark, "part_ds", "tabloom_rt")


def _parts(spark, sf):
    d = hash_split(f_class(spark, sf), KEY, 25, 7)
    return d.where(~F.col("is_test")).drop("is_test"), d.where(F.col("is_test")).drop("is_test")


@register("predictions_csv")
def predictions_csv(spark, sf):
    train, test = _parts(spark, sf)
    fitted = learners("classification")["Logistic Regression"].fit(train, FEATS, "y")
    pred = predict(fitted, test).select(*KEY, "y", "Predictions", "Probability")
    path = scratch_path(spark, "pred")
    S.write_predictions_csv(pred, path)
    return round_doubles(S.read_csv(spark, path, pred.schema), 6)


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    train, test = _parts(spark, sf)
    fitted = learners("classification")["Decision Tree"].fit(train, FEATS, "y")
    path = scratch_path(spark, "model")
    registry = scratch_path(spark, "registry")
    ST.save_model(spark, fitted, path, registry=registry)
    loaded = ST.load_model(spark, path)
    a = predict(fitted, test).select(*KEY, F.col("Predictions").alias("p_before"))
    b = predict(loaded, test).select(*KEY, F.col("Predictions").alias("p_after"))
    if fitted.name not in [r["model_name"] for r in ST.list_models(spark, registry).collect()]:
        raise RuntimeError("saved model not in the registry")
    return a.join(b, KEY)


@register("leaderboard_roundtrip")
def leaderboard_roundtrip(spark, sf):
    from tabloom.plans.leaderboard import fit_and_rank
    board, _ = fit_and_rank(f_class(spark, sf), FEATS, "y", "classification", KEY, ["Gaussian NB"])
    path = scratch_path(spark, "board")
    ST.save_leaderboard(board, path)
    return ST.load_leaderboard(spark, path).drop("fit_time")
