"""Profile and chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.exprs import round_doubles
from tabloom.operators import profile as P
from tabloom.plans.catalog import register
from tabloom.session import spread
from tabloom.sources.tables import f_class, table, with_fixtures

R = 6  # decimals kept for doubles in comparisons


def _describe_sql(tbl: str, cols: list[tuple[str, str, bool]]) -> str:
    parts = []
    for c, dtype, numeric in cols:
        if numeric:
            parts.append(f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, count({c}) AS "count",
  count(*) - count({c}) AS missing, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top,
  CAST(NULL AS BIGINT) AS freq, round(avg(CAST({c} AS DOUBLE)), {R}) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), {R}) AS std, round(CAST(min({c}) AS DOUBLE), {R}) AS "min",
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), {R}) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), {R}) AS p50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), {R}) AS p75, round(CAST(max({c}) AS DOUBLE), {R}) AS "max"
FROM {tbl}""")
        else:
            top = f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {tbl} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
            freq = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c}))"
            parts.append(f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, count({c}) AS "count",
  count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique", {top} AS top, {freq} AS freq,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS "min",
  CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75, CAST(NULL AS DOUBLE) AS "max"
FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


CUSTOMER_COLS = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
                 ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]


@register("describe_customer", _describe_sql("customer", CUSTOMER_COLS))
def describe_customer(spark, sf):
    return round_doubles(P.describe(table(spark, sf, "customer")), R)


ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@register("column_list_orders", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(DISTINCT {c}) AS "distinct",
  count(*) FILTER (WHERE {c} IS NULL) AS missing FROM orders""" for c, t in ORDERS_COLS))
def column_list_orders(spark, sf):
    return P.column_list(table(spark, sf, "orders"))


LINEITEM_COLS = [("l_orderkey", "bigint", "int"), ("l_partkey", "bigint", "int"), ("l_suppkey", "bigint", "int"),
                 ("l_linenumber", "int", "int"), ("l_quantity", "double", "float"),
                 ("l_extendedprice", "double", "float"), ("l_discount", "double", "float"),
                 ("l_tax", "double", "float"), ("l_returnflag", "string", "other"),
                 ("l_linestatus", "string", "other"), ("l_shipdate", "timestamp_ntz", "other")]


def _problem_sql(c, dtype, kind):
    nu = f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"
    if kind == "other":
        rule = f"CASE WHEN {nu} <= 2 THEN 'Binary_Classification' ELSE 'Multi_Classification' END"
    else:
        lim = 30 if kind == "int" else 15
        rule = (f"CASE WHEN {nu} <= 2 THEN 'Binary_Classification' WHEN {nu} <= {lim} "
                f"THEN 'Multi_Classification' ELSE 'Regression' END")
    return (f"""SELECT '{c}' AS "column", '{dtype}' AS dtype, CAST({nu} AS BIGINT) AS n_unique, {rule} AS problem_type
FROM lineitem""")


@register("problem_type_all", "\nUNION ALL\n".join(_problem_sql(*t) for t in LINEITEM_COLS))
def problem_type_all(spark, sf):
    return P.problem_types(table(spark, sf, "lineitem"))


def _hist_sql(tbl, c, nbins, column_label=None):
    lab = f"'{column_label}' AS \"column\", 'hist' AS kind, " if column_label else ""
    cat = ", CAST(NULL AS VARCHAR) AS category" if column_label else ""
    dens = "" if column_label else ", round(count(*) / (n * ((hi - lo) / " + str(nbins) + ")), 12) AS density"
    return f"""SELECT {lab}CAST(bin AS BIGINT) AS bin,
  round(lo + bin * ((hi - lo) / {nbins}), {R}) AS lower, round(lo + (bin + 1) * ((hi - lo) / {nbins}), {R}) AS upper{cat},
  count(*) AS "count"{dens}
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {tbl} WHERE {c} IS NOT NULL) d,
     (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS n FROM {tbl}) s,
     LATERAL (SELECT least(greatest(floor((v - lo) / ((hi - lo) / {nbins})), 0), {nbins - 1}) AS bin)
GROUP BY bin, lo, hi, n"""


@register("hist_extendedprice", _hist_sql("lineitem", "l_extendedprice", 10))
def hist_extendedprice(spark, sf):
    h = P.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10)
    return h.select("bin", F.round("lower", R).alias("lower"), F.round("upper", R).alias("upper"), "count",
                    F.round("density", 12).alias("density"))


@register("kde_event_value", f"""WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n,
       stddev_samp(value) AS sd FROM events),
p AS (SELECT lo, n, sd * pow(n, -0.2) AS h, (hi - lo) / 49 AS step FROM s),
g AS (SELECT i AS point, lo + i * step AS x, h, n FROM p, range(50) t(i))
SELECT CAST(point AS BIGINT) AS point, round(x, {R}) AS x,
       round(sum(exp(-0.5 * pow((x - e.value) / h, 2))) / (n * h * sqrt(2 * pi())), 12) AS density
FROM g, events e WHERE e.value IS NOT NULL GROUP BY point, x, h, n""")
def kde_event_value(spark, sf):
    k = P.kde(table(spark, sf, "events"), "value", 50)
    return k.select("point", F.round("x", R).alias("x"), F.round("density", 12).alias("density"))


BOX_SQL = f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
         quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL GROUP BY event_type),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.event_type, count(*) AS n, round(q1, {R}) AS q1, round(median, {R}) AS median, round(q3, {R}) AS q3,
  round(iqr, {R}) AS iqr, round(lower_fence, {R}) AS lower_fence, round(upper_fence, {R}) AS upper_fence,
  round(min(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END), {R}) AS whisker_low,
  round(max(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END), {R}) AS whisker_high,
  count(*) FILTER (WHERE NOT (value >= lower_fence AND value <= upper_fence)) AS n_outliers
FROM events e JOIN f ON e.event_type IS NOT DISTINCT FROM f.event_type
WHERE value IS NOT NULL
GROUP BY f.event_type, q1, median, q3, iqr, lower_fence, upper_fence"""


@register("box_event_value_by_type", BOX_SQL)
def box_event_value_by_type(spark, sf):
    return round_doubles(P.box_stats(table(spark, sf, "events"), "value", ["event_type"]), R)


@register("box_event_value", f"""WITH f AS (SELECT q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
  q3 + 1.5 * (q3 - q1) AS upper_fence FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL))
SELECT count(*) AS n, round(q1, {R}) AS q1, round(median, {R}) AS median, round(q3, {R}) AS q3,
  round(iqr, {R}) AS iqr, round(lower_fence, {R}) AS lower_fence, round(upper_fence, {R}) AS upper_fence,
  round(min(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END), {R}) AS whisker_low,
  round(max(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END), {R}) AS whisker_high,
  count(*) FILTER (WHERE NOT (value >= lower_fence AND value <= upper_fence)) AS n_outliers
FROM events, f WHERE value IS NOT NULL GROUP BY q1, median, q3, iqr, lower_fence, upper_fence""")
def box_event_value(spark, sf):
    return round_doubles(P.box_stats(table(spark, sf, "events"), "value"), R)


@register("count_flag_status", """SELECT l_returnflag, l_linestatus, count(*) AS "count"
FROM lineitem GROUP BY 1, 2""")
def count_flag_status(spark, sf):
    return P.count_values(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("pie_price_by_priority", """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total,
  round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 9) AS share
FROM orders GROUP BY 1""")
def pie_price_by_priority(spark, sf):
    p = P.pie(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return p.select("o_orderpriority", F.round("total", 2).alias("total"), F.round("share", 9).alias("share"))


def _graph_view_customer_sql():
    parts = [_hist_sql("customer", c, 10, c) for c in ("c_custkey", "c_nationkey", "c_acctbal")]
    parts.append("""SELECT 'c_mktsegment' AS "column", 'count' AS kind, CAST(NULL AS BIGINT) AS bin,
  CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, c_mktsegment AS category, count(*) AS "count"
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
    return "\nUNION ALL\n".join(parts)


@register("graph_view_customer", _graph_view_customer_sql())
def graph_view_customer(spark, sf):
    g = P.graph_view(table(spark, sf, "customer"), 10, 10)
    return g.select("column", "kind", "bin", F.round("lower", R).alias("lower"), F.round("upper", R).alias("upper"),
                    "category", "count")


@register("scatter_part", f"""WITH s AS (SELECT CAST(min(p_partkey) AS DOUBLE) AS x0, CAST(max(p_partkey) AS DOUBLE) AS x1,
  min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part),
b AS (SELECT least(greatest(floor((CAST(p_partkey AS DOUBLE) - x0) / ((x1 - x0) / 20)), 0), 19) AS x_bin,
             least(greatest(floor((p_retailprice - y0) / ((y1 - y0) / 20)), 0), 19) AS y_bin, x0, x1, y0, y1
      FROM part, s WHERE p_partkey IS NOT NULL AND p_retailprice IS NOT NULL)
SELECT CAST(x_bin AS BIGINT) AS x_bin, CAST(y_bin AS BIGINT) AS y_bin,
  round(x0 + x_bin * ((x1 - x0) / 20), {R}) AS x_lower, round(y0 + y_bin * ((y1 - y0) / 20), {R}) AS y_lower,
  count(*) AS "count"
FROM b GROUP BY x_bin, y_bin, x0, x1, y0, y1""")
def scatter_part(spark, sf):
    s = P.scatter_bins(table(spark, sf, "part"), "p_partkey", "p_retailprice", 20, 20)
    return round_doubles(s, R)


@register("line_orders_daily", f"""SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), {R}) AS o_totalprice,
  count(*) AS n FROM orders GROUP BY 1""")
def line_orders_daily(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return round_doubles(P.line(o, "day", "o_totalprice"), R)


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


N_WIDE = 61


def _wide_sql(i: int) -> str:
    """Column ``i`` of a wide table with scattered nulls (the same text runs on Spark)."""
    return (f"CASE WHEN (l_partkey + {i}) % 11 = 0 THEN NULL "
            f"ELSE CAST((l_orderkey * 7919) % {23 + i} AS DOUBLE) + l_quantity * {i % 5} END")


@register("corr_matrix_wide", "WITH w AS (SELECT " + ", ".join(f"{_wide_sql(i)} AS w{i}" for i in range(N_WIDE))
          + " FROM lineitem),\nm AS (SELECT " + ", ".join(
              f"round(corr(w{i}, w{j}), 8) AS r{i}_{j}" for i in range(N_WIDE) for j in range(i, N_WIDE))
          + " FROM w)\n" + "\nUNION ALL\n".join(
              f"SELECT 'w{i}' AS col_a, 'w{j}' AS col_b, r{min(i, j)}_{max(i, j)} AS corr FROM m"
              for i in range(N_WIDE) for j in range(N_WIDE)))
def corr_matrix_wide(spark, sf):
    """More columns than one aggregate takes; no row is complete in all of them."""
    # the three columns are dealt over the cores before they become many
    li = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"))
    d = li.selectExpr(*[f"{_wide_sql(i)} AS w{i}" for i in range(N_WIDE)])
    return round_doubles(P.corr_matrix(d), 8)


@register("corr_matrix_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 8) AS corr FROM lineitem"
    for a in LI_NUM for b in LI_NUM))
def corr_matrix_lineitem(spark, sf):
    return round_doubles(P.corr_matrix(table(spark, sf, "lineitem"), LI_NUM), 8)


def _corr_with_sql(tbl, target, cols, pre=""):
    sel = "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", corr({c}, {target}) AS c FROM {tbl}" for c in cols)
    return (f"""{pre}SELECT "column", round(c, 8) AS corr,
  row_number() OVER (ORDER BY abs(c) DESC, "column") AS rank FROM ({sel})""")


@register("corr_with_price", _corr_with_sql("lineitem", "l_extendedprice",
                                            ["l_quantity", "l_discount", "l_tax", "l_linenumber"]))
def corr_with_price(spark, sf):
    d = P.corr_with(table(spark, sf, "lineitem"), "l_extendedprice",
                    ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return round_doubles(d, 8)


@register("corr_target", with_fixtures(
    "SELECT \"column\", round(c, 8) AS corr, row_number() OVER (ORDER BY abs(c) DESC, \"column\") AS rank FROM ("
    + "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", corr({c}, y) AS c FROM f_class" for c in ["x1", "x2", "x3", "y"])
    + ")", "f_class"))
def corr_target(spark, sf):
    d = P.corr_with(f_class(spark, sf), "y", ["x1", "x2", "x3"], keep_self=True)
    return round_doubles(d, 8)


@register("vif_two_features", f"""WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b,
  sum(l_discount * l_discount) AS c FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)
SELECT 'l_quantity' AS feature, round(a * c / (a * c - b * b), {R}) AS vif FROM g
UNION ALL SELECT 'l_discount', round(a * c / (a * c - b * b), {R}) FROM g""")
def vif_two_features(spark, sf):
    return round_doubles(P.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), R)


def _g(i: int, j: int) -> str:
    a, b = sorted((i, j))
    return f"g{a}{b}"


def _det_sql(rows: list[int], cols: list[int] | None = None) -> str:
    """Determinant of the Gram sub-matrix ``rows x cols`` as SQL (cofactor expansion on the first row)."""
    cols = rows if cols is None else cols
    if len(rows) == 1:
        return _g(rows[0], cols[0])
    terms = []
    for k, c in enumerate(cols):
        sub = _det_sql(rows[1:], cols[:k] + cols[k + 1:])
        terms.append(f"{'-' if k % 2 else '+'} {_g(rows[0], c)} * ({sub})")
    return " ".join(terms).lstrip("+ ")


def _vif_sql(cols: list[str]) -> str:
    # minors drop row and column j: for a symmetric Gram matrix the first-row expansion above applies
    p = len(cols)
    grams = ", ".join(f"sum({cols[i]} * {cols[j]}) AS g{i}{j}" for i in range(p) for j in range(i, p))
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    full = _det_sql(list(range(p)))
    parts = []
    for j, c in enumerate(cols):
        minor = _det_sql([i for i in range(p) if i != j])
        parts.append(f"SELECT '{c}' AS feature, round(g{j}{j} * ({minor}) / ({full}), {R}) AS vif FROM g")
    return f"WITH g AS (SELECT {grams} FROM lineitem WHERE {notnull})\n" + "\nUNION ALL\n".join(parts)


@register("vif_lineitem", _vif_sql(LI_NUM))
def vif_lineitem(spark, sf):
    return round_doubles(P.vif(table(spark, sf, "lineitem"), LI_NUM), R)


@register("vif_centered_two", f"""WITH g AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b,
  var_pop(l_tax) AS c FROM lineitem WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL)
SELECT 'l_quantity' AS feature, round(a * c / (a * c - b * b), {R}) AS vif FROM g
UNION ALL SELECT 'l_tax', round(a * c / (a * c - b * b), {R}) FROM g""")
def vif_centered_two(spark, sf):
    return round_doubles(P.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], centered=True), R)


@register("describe_column_acctbal", _describe_sql("customer", [("c_acctbal", "double", True)]))
def describe_column_acctbal(spark, sf):
    parts = P.describe_column(table(spark, sf, "customer"), "c_acctbal")
    return round_doubles(parts["summary"], R)


@register("column_list_orders_approx", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM orders"""
    for c, t in ORDERS_COLS))
def column_list_orders_approx(spark, sf):
    # the approximate distinct count is checked by tests (relative error); the rest by SQL
    return P.column_list(table(spark, sf, "orders"), approx=True).drop("distinct")


@register("describe_column_parts", f"""WITH h AS ({_hist_sql("customer", "c_acctbal", 10)}),
c AS ({_corr_with_sql("customer", "c_acctbal", ["c_custkey", "c_nationkey"])})
SELECT 'column' AS part, 'c_acctbal' AS name, CAST(count(DISTINCT c_acctbal) AS DOUBLE) AS a, CAST(count(*) - count(c_acctbal) AS DOUBLE) AS b FROM customer
UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), CAST("count" AS DOUBLE), round(lower, {R}) FROM h
UNION ALL SELECT 'correlations', "column", round(corr, 8), CAST(rank AS DOUBLE) FROM c""")
def describe_column_parts(spark, sf):
    """The other tables of describe_column in one: distinct and missing, histogram, correlations."""
    parts = P.describe_column(table(spark, sf, "customer"), "c_acctbal")
    d = lambda c: F.col(c).cast("double")
    rows = parts["column"].select(F.lit("column").alias("part"), F.col("column").alias("name"), d("distinct").alias("a"), d("missing").alias("b"))
    rows = rows.unionByName(parts["histogram"].select(
        F.lit("histogram").alias("part"), F.col("bin").cast("string").alias("name"), d("count").alias("a"), F.round("lower", R).alias("b")))
    return rows.unionByName(parts["correlations"].select(
        F.lit("correlations").alias("part"), F.col("column").alias("name"), F.round("corr", 8).alias("a"), d("rank").alias("b")))


@register("scatter_sample_part", """SELECT p_partkey, p_partkey AS x, p_retailprice AS y FROM part
WHERE CAST(('0x' || substr(md5(concat('3:', CAST(p_partkey AS VARCHAR))), 1, 8)) AS BIGINT) < 429496729""")
def scatter_sample_part(spark, sf):
    p = table(spark, sf, "part").withColumn("x", F.col("p_partkey")).withColumn("y", F.col("p_retailprice"))
    return P.scatter_sample(p, "x", "y", 0.1, seed=3, key="p_partkey")
