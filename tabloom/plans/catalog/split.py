"""Split and fold queries."""

from __future__ import annotations

from tabloom.functions.scan import row_numbers
from tabloom.operators import split as S
from tabloom.plans.catalog import register
from tabloom.sources.tables import table

HASH = "md5(concat('7:', CAST({k} AS VARCHAR)))"


@register("split_train_test", f"""SELECT c_custkey, substr({HASH.format(k='c_custkey')}, 1, 4) < '4000' AS is_test
FROM customer""")
def split_train_test(spark, sf):
    return S.hash_split(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 25, 7)


@register("split_stratified", f"""WITH h AS (SELECT doc_id, toxic, {HASH.format(k='doc_id')} AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) AS rk,
        count(*) OVER (PARTITION BY toxic) AS n FROM h)
SELECT doc_id, toxic, rk <= floor(n * 0.25 + 0.5) AS is_test FROM r""")
def split_stratified(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    return S.stratified_split(lab, ["doc_id"], "toxic", 25, 7)


@register("kfold", f"""SELECT c_custkey,
  CAST(CAST(('0x' || substr({HASH.format(k='c_custkey')}, 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM customer""")
def kfold(spark, sf):
    return S.kfold(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 5, 7)


@register("stratified_kfold", f"""WITH h AS (SELECT doc_id, quality, {HASH.format(k='doc_id')} AS h FROM labels)
SELECT doc_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1) % 5 AS INTEGER) AS fold FROM h""")
def stratified_kfold(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return S.stratified_kfold(lab, ["doc_id"], "quality", 5, 7)


@register("shuffle_split", """SELECT CAST(s.i AS INTEGER) AS split, c_custkey,
  substr(md5(concat('7-', CAST(s.i AS VARCHAR), ':', CAST(c_custkey AS VARCHAR))), 1, 4) < '199a' AS is_test
FROM customer, range(3) s(i)""")
def shuffle_split(spark, sf):
    return S.shuffle_split(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 3, 10, 7)


@register("repeated_kfold", """SELECT CAST(r.i AS INTEGER) AS "repeat", c_custkey,
  CAST(CAST(('0x' || substr(md5(concat('7-', CAST(r.i AS VARCHAR), ':', CAST(c_custkey AS VARCHAR))), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold
FROM customer, range(3) r(i)""")
def repeated_kfold(spark, sf):
    return S.repeated_kfold(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], 5, 3, 7)


@register("row_number_text", """SELECT c_name, c_custkey,
  row_number() OVER (ORDER BY c_name, c_custkey) AS row_number FROM customer""")
def row_number_text(spark, sf):
    """Text that differs only after a long common prefix."""
    return row_numbers(table(spark, sf, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"])


@register("row_number_repeats", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax,
  row_number() OVER (ORDER BY l_tax, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_number FROM lineitem""")
def row_number_repeats(spark, sf):
    """An order column of a few values, each a large share of all rows."""
    cols = ["l_tax", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return row_numbers(table(spark, sf, "lineitem").select(*cols), cols)
