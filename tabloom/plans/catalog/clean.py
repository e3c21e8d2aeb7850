"""Cleaning, cast and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.exprs import round_doubles
from tabloom.operators import clean as C
from tabloom.operators import join as J
from tabloom.plans.catalog import register
from tabloom.sources.tables import f_dirty, f_null, f_scored, table, with_fixtures


@register("select_cols", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_cols(spark, sf):
    return C.select_columns(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@register("drop_cols", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_cols(spark, sf):
    return C.drop_columns(table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority", "not_there"])


@register("cast_int", with_fixtures(
    "SELECT o_orderkey, cust_txt, TRY_CAST(nullif(trim(cust_txt), '') AS BIGINT) AS cust_txt_int FROM f_dirty",
    "f_dirty"))
def cast_int(spark, sf):
    return C.to_int(f_dirty(spark, sf), ["cust_txt"]).select("o_orderkey", "cust_txt", "cust_txt_int")


@register("cast_float", with_fixtures(
    """SELECT o_orderkey, price_txt,
  TRY_CAST(nullif(regexp_replace(price_txt, '[ ?,!/;:$'']', '', 'g'), '') AS DOUBLE) AS price_txt_float FROM f_dirty""",
    "f_dirty"))
def cast_float(spark, sf):
    return C.to_float(f_dirty(spark, sf), ["price_txt"]).select("o_orderkey", "price_txt", "price_txt_float")


@register("cast_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey_string FROM orders")
def cast_string(spark, sf):
    return C.to_string(table(spark, sf, "orders"), ["o_custkey"]).select("o_orderkey", "o_custkey_string")


@register("remove_symbols", with_fixtures(
    """SELECT o_orderkey,
  TRY_CAST(nullif(regexp_replace(price_txt, '[ ?,!/;:$]', '', 'g'), '') AS DOUBLE) AS price_txt FROM f_dirty""",
    "f_dirty"))
def remove_symbols(spark, sf):
    return C.remove_symbols(f_dirty(spark, sf), ["price_txt"]).select("o_orderkey", "price_txt")


@register("to_datetime", with_fixtures(
    "SELECT o_orderkey, CAST(try_strptime(date_txt, '%Y-%m-%d') AS TIMESTAMP) AS date_txt FROM f_dirty", "f_dirty"))
def to_datetime(spark, sf):
    return C.to_datetime(f_dirty(spark, sf), ["date_txt"], "yyyy-MM-dd").select("o_orderkey", "date_txt")


# The casts are the ones the min/max pass picks at sf0.01 (keys < 32768, sizes < 128).
@register("downcast_part", """SELECT CAST(p_partkey AS SMALLINT) AS p_partkey, p_name, p_brand, p_type,
  CAST(p_size AS TINYINT) AS p_size, p_retailprice FROM part""")
def downcast_part(spark, sf):
    return C.downcast_numeric(table(spark, sf, "part"))


@register("drop_nulls", with_fixtures(
    "SELECT * FROM f_null WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL", "f_null"))
def drop_nulls(spark, sf):
    return C.drop_nulls(f_null(spark, sf), ["c_acctbal", "c_mktsegment"])


@register("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_orders(spark, sf):
    return C.preview(table(spark, sf, "orders"), 20, ["o_orderkey"])


@register("null_guard_counts", with_fixtures(
    """SELECT 'c_acctbal' AS "column", count(*) FILTER (WHERE c_acctbal IS NULL OR isnan(c_acctbal)) AS nulls FROM f_null
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (WHERE c_mktsegment IS NULL) FROM f_null
UNION ALL SELECT 'c_nationkey', count(*) FILTER (WHERE c_nationkey IS NULL) FROM f_null""", "f_null"))
def null_guard_counts(spark, sf):
    return C.null_counts(f_null(spark, sf), ["c_acctbal", "c_mktsegment", "c_nationkey"])


@register("add_suffix", "SELECT o_orderkey AS o_orderkey_key, o_totalprice AS o_totalprice_key FROM orders")
def add_suffix(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.add_suffix(o, ["o_orderkey", "o_totalprice"], "_key")


@register("merge_inner", """SELECT c.*, o.* FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey""")
def merge_inner(spark, sf):
    return J.merge(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey", "inner")


@register("merge_left", """SELECT n.*, s.* FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey""")
def merge_left(spark, sf):
    return J.merge(table(spark, sf, "nation"), table(spark, sf, "supplier"), "n_nationkey", "s_nationkey", "left")


@register("merge_right", """SELECT o.*, c.* FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey""")
def merge_right(spark, sf):
    return J.merge(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "right")


@register("merge_suffixes", """SELECT a.o_orderkey, a.o_custkey AS o_custkey_x, a.o_totalprice AS o_totalprice_x,
  b.o_custkey AS o_custkey_y, b.o_totalprice AS o_totalprice_y
FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) a
JOIN (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') b ON a.o_orderkey = b.o_orderkey""")
def merge_suffixes(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select("o_orderkey", "o_custkey", "o_totalprice")
    b = o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.merge(a, b, "o_orderkey", "o_orderkey", "inner")


@register("merge_null_safe", with_fixtures(
    """SELECT f.c_custkey, f.c_mktsegment, s.seg, s.n_seg
FROM f_null f JOIN (SELECT c_mktsegment AS seg, count(*) AS n_seg FROM f_null GROUP BY 1) s
  ON f.c_mktsegment IS NOT DISTINCT FROM s.seg""", "f_null"))
def merge_null_safe(spark, sf):
    f = f_null(spark, sf).select("c_custkey", "c_mktsegment")
    segs = f.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n_seg"))
    return J.merge(f, segs, "c_mktsegment", "seg", "inner", null_safe=True)


@register("concat_columns", """SELECT *, round(ln(1 + o_totalprice), 9) AS o_totalprice_log,
  CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders""")
def concat_columns(spark, sf):
    o = table(spark, sf, "orders")
    return J.concat_columns(o, {"o_totalprice_log": F.round(F.log1p("o_totalprice"), 9),
                                "o_year": F.year("o_orderdate")})


@register("registry_append", with_fixtures(
    """SELECT 'score_ge_0_5' AS model, round(avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
  count(*) AS n FROM f_scored
UNION ALL
SELECT 'score_ge_0_3', round(avg(CASE WHEN (score >= 0.3) = (y = 1) THEN 1.0 ELSE 0.0 END), 9), count(*) FROM f_scored""",
    "f_scored"))
def registry_append(spark, sf):
    s = f_scored(spark, sf)

    def board(name, thr):
        hit = ((F.col("score") >= thr) == (F.col("y") == 1)).cast("double")
        return s.agg(F.lit(name).alias("model"), F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))

    return round_doubles(J.append_rows(board("score_ge_0_5", 0.5), board("score_ge_0_3", 0.3)), 9)
