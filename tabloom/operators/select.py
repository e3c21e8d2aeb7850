"""Feature selection (K1 select-k-best, K2 automatic L1 selection, K3 recursive elimination)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark import StorageLevel

from tabloom.functions.exprs import clean_num, gauss, row_key
from tabloom.functions.quantile import quantile_table
from tabloom.functions.scan import order_buckets, prefix_sums
from tabloom.operators.models import SparkMLLearner
from tabloom.session import cut_lineage


def _bin_expr(v, edges: list[float]):
    """Number of edges strictly below the value: bins 0..len(edges)."""
    if not edges:
        return F.lit(0)
    return sum((F.when(v > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))


def quantile_edges(df: DataFrame, cols: list[str], bins: int) -> dict[str, list[float]]:
    probs = [i / bins for i in range(1, bins)]
    q = quantile_table(df, cols, probs).collect()[0]
    return {c: list(q[c] or []) for c in cols}


def mutual_information(df: DataFrame, features: list[str], label: str, problem: str = "classification",
                       bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) between each feature and the target.

    Features (and a regression target) are cut at their exact deciles; the
    joint counts of all features come from one unpivot and one group-by.
    """
    edges = quantile_edges(df, features + ([label] if problem == "regression" else []), bins)
    y = _bin_expr(clean_num(label), edges[label]) if problem == "regression" else F.col(label)
    pairs = []
    for f in features:
        pairs += [F.lit(f), _bin_expr(clean_num(f), edges[f])]
    long = df.where(F.col(label).isNotNull()).select(
        y.alias("_y"), F.stack(F.lit(len(features)), *pairs).alias("feature", "_b"))
    joint = long.groupBy("feature", "_b", "_y").agg(F.count(F.lit(1)).alias("c"))
    wx = Window.partitionBy("feature", "_b")
    wy = Window.partitionBy("feature", "_y")
    wn = Window.partitionBy("feature")
    j = joint.withColumn("cx", F.sum("c").over(wx)).withColumn("cy", F.sum("c").over(wy)) \
             .withColumn("n", F.sum("c").over(wn))
    c, n, cx, cy = (F.col(x).cast("double") for x in ("c", "n", "cx", "cy"))
    term = c / n * F.log(c * n / (cx * cy))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


# nearest neighbours of the mutual information estimate; points on its radius are left out of the
# counts by a relative margin far above rounding
MI_NEIGHBOURS = 3
MI_INSIDE = 1 - 1e-10


def digamma(n: Column) -> Column:
    """Digamma of a positive whole number: exact sums up to 20, the asymptotic series beyond."""
    small = [-0.5772156649015329 + sum(1.0 / i for i in range(1, k)) for k in range(1, 21)]
    x = n.cast("double")
    y = 1 / (x * x)
    series = F.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))
    return F.when(n <= 20, F.get(F.array(*[F.lit(v) for v in small]), (n - 1).cast("int"))).otherwise(series)


def _unpivot(df: DataFrame, features: list[str], *extra: Column) -> DataFrame:
    """feature, x (double) and the extra columns; one row per value that is there."""
    pairs = []
    for f in features:
        pairs += [F.lit(f), clean_num(f)]
    return df.select(*extra, F.stack(F.lit(len(features)), *pairs).alias("feature", "x")).where("x is not null")


def counts_within(points: DataFrame, queries: DataFrame, groups: list[str]) -> DataFrame:
    """``queries`` (groups, x, r) with ``m``: how many points (groups, x, n) have |value - x| within r.

    Interval ends and points are put in one order per group and counted by a distributed running sum:
    a point stands after an interval's lower end and before its upper one.
    """
    ends = queries.select(*groups, (F.col("x") - F.col("r")).alias("v"), F.lit(0).alias("after")).unionByName(
        queries.select(*groups, (F.col("x") + F.col("r")).alias("v"), F.lit(2).alias("after"))).distinct()
    both = points.groupBy(*groups, F.col("x").alias("v")).agg(F.sum("n").alias("n")).withColumn("after", F.lit(1)) \
        .unionByName(ends.withColumn("n", F.lit(0).cast("bigint")).select(*groups, "v", "n", "after"))
    upto = cut_lineage(prefix_sums(both, ["v", "after"], {"upto": "n"}, groups).where("after <> 1"))
    low = upto.where("after = 0").select(*groups, F.col("v").alias("_lo"), F.col("upto").alias("_below"))
    high = upto.where("after = 2").select(*groups, F.col("v").alias("_hi"), F.col("upto").alias("_upto"))
    q = queries.withColumn("_lo", F.col("x") - F.col("r")).withColumn("_hi", F.col("x") + F.col("r"))
    return q.join(low, [*groups, "_lo"]).join(high, [*groups, "_hi"]) \
        .withColumn("m", F.col("_upto") - F.col("_below")).drop("_lo", "_hi", "_below", "_upto")


def _radii(values: DataFrame, k: int) -> DataFrame:
    """Radius to the k-th nearest other point of the same (feature, y), per distinct value.

    ``values``: feature, y, x, n (rows at x).  Each ordered bucket also holds the ``k`` nearest values
    of both neighbouring buckets that have any, so no neighbour is missed; a value with more than k
    rows has radius 0, a (feature, y) with fewer than k others takes the farthest of them.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(order_buckets(values, ["feature", "y", "x"], n))
    w = Window.partitionBy("_bk", "feature", "y")
    # the k first and last values of each bucket, handed to the buckets before and after
    edges = cut.select("*", F.row_number().over(w.orderBy("x")).alias("_a"), F.row_number().over(w.orderBy(F.desc("x"))).alias("_z"))
    sent = _handed(edges, k, True).unionByName(_handed(edges, k, False))
    own = cut.withColumn("_own", F.lit(True)).unionByName(sent.withColumn("_own", F.lit(False)))
    at = w.orderBy("x")
    near = [F.struct(F.abs(F.lag("x", d).over(at) - F.col("x")).alias("d"), F.lag("n", d).over(at).alias("n")) for d in range(1, k + 1)]
    near += [F.struct(F.abs(F.lead("x", d).over(at) - F.col("x")).alias("d"), F.lead("n", d).over(at).alias("n")) for d in range(1, k + 1)]
    sized = own.select("*", F.array_sort(F.filter(F.array(
        F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n")), *near), lambda s: s["d"].isNotNull() & (s["n"] > 0))).alias("_near")) \
        .where("_own")
    total = values.groupBy(F.col("feature").alias("_f"), F.col("y").alias("_y")).agg(F.sum("n").alias("of"))
    sized = sized.join(total, (F.col("feature") == F.col("_f")) & F.col("y").eqNullSafe(F.col("_y"))).drop("_f", "_y")
    kk = F.least(F.lit(k).cast("bigint"), F.col("of") - 1)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("r"))
    reach = F.aggregate("_near", zero, lambda a, s: F.struct(
        (a["n"] + s["n"]).alias("n"), F.when(a["r"].isNull() & (a["n"] + s["n"] >= kk), s["d"]).otherwise(a["r"]).alias("r")),
        lambda a: a["r"])
    return sized.where("of > 1").select("feature", "y", "x", "n", "of", kk.alias("k"), reach.alias("r"))


def _handed(edges: DataFrame, k: int, up: bool) -> DataFrame:
    """The last k values before each bucket (``up``) or the first k after it, of the same (feature, y)."""
    rank = "_z" if up else "_a"
    ends = edges.where(F.col(rank) <= k).groupBy("feature", "y", "_bk").agg(
        F.sort_array(F.collect_list(F.struct(rank, "x", "n"))).alias("_v"))
    # one row per bucket and (feature, y): the lists of as many buckets as it takes to have k values
    w = Window.partitionBy("feature", "y").orderBy("_bk" if up else F.desc("_bk")).rowsBetween(-k, -1)
    held = ends.withColumn("_prev", F.flatten(F.reverse(F.collect_list("_v").over(w))))
    return held.select("feature", "y", "_bk", F.explode(F.slice("_prev", 1, k)).alias("s")).select(
        "feature", "y", F.col("s.x").alias("x"), F.col("s.n").alias("n"), "_bk")


def mutual_information_knn(df: DataFrame, features: list[str], label: str, problem: str = "classification",
                           key_cols: list[str] | None = None, k: int = MI_NEIGHBOURS) -> DataFrame:
    """Nearest-neighbour mutual information (nats): Ross for classes, Kraskov for a numeric target.

    (feature, mi), at least 0.  Rows without the label are left out, and so is a feature's missing value.
    """
    rows = df.where(F.col(label).isNotNull())
    if problem == "classification":
        values = _unpivot(rows, features, F.col(label).cast("string").alias("y")) \
            .groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("n"))
        values = cut_lineage(values)
        # classes of one row have no neighbour: left out of everything
        radii = cut_lineage(_radii(values, k).withColumn("r", F.col("r") * F.lit(MI_INSIDE)))
        found = counts_within(radii.select("feature", "x", "n"), radii.select("feature", "x", "r", "n", "k", "of"), ["feature"])
        parts = found.groupBy("feature").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * (digamma(F.col("k")) - digamma(F.col("of")) - digamma(F.col("m")))).alias("s"))
        mi = digamma(F.col("n")) + F.col("s") / F.col("n")
        return parts.select("feature", F.greatest(F.lit(0.0), mi).alias("mi"))
    return _numeric_mi(rows, features, label, key_cols, k)


def _numeric_mi(rows: DataFrame, features: list[str], label: str, key_cols: list[str] | None, k: int) -> DataFrame:
    from tabloom.operators.knn import neighbours, unique_key
    spark = rows.sparkSession
    out = None
    y = clean_num(label)
    for f in features:
        pair = rows.select(*(key_cols or []), clean_num(f).alias("a"), y.alias("b")).where("a is not null and b is not null")
        st = pair.agg(F.stddev_pop("a").alias("a"), F.stddev_pop("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
        if st["n"] <= k:
            one = spark.createDataFrame([(f, 0.0)], "feature string, mi double")
        else:
            scaled = pair.withColumn("a", F.col("a") / F.lit(st["a"] or 1.0)).withColumn("b", F.col("b") / F.lit(st["b"] or 1.0))
            keyed = cut_lineage(unique_key(scaled, "_id", key_cols).select("_id", "a", "b"))
            near = neighbours(keyed, "_id", keyed, "_id", ["a", "b"], k, "chebyshev", exclude_self=True)
            radius = cut_lineage(near.groupBy("qkey").agg((F.max("dist") * F.lit(MI_INSIDE)).alias("r")).join(
                keyed, F.col("qkey") == F.col("_id")).select("a", "b", "r"))
            points = keyed.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in "ab"])).alias("s")) \
                .select("s.feature", "s.x", F.lit(1).cast("bigint").alias("n"))
            asked = radius.select("r", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in "ab"])).alias("s")) \
                .select("s.feature", "s.x", "r").groupBy("feature", "x", "r").agg(F.count(F.lit(1)).alias("n"))
            got = counts_within(points, asked, ["feature"]).agg(F.sum(F.col("n") * digamma(F.col("m"))).alias("s"))
            mi = digamma(F.lit(st["n"])) + digamma(F.lit(k)) - F.col("s") / F.lit(float(st["n"]))
            one = got.select(F.lit(f).alias("feature"), F.greatest(F.lit(0.0), mi).alias("mi"))
        out = one if out is None else out.unionByName(one)
    return out


def select_k_best(df: DataFrame, features: list[str], label: str, k: int | None = None,
                  problem: str = "classification", bins: int = 10, estimator: str = "knn",
                  key_cols: list[str] | None = None) -> DataFrame:
    """Features ranked by mutual information; ``selected`` marks the top ``k`` (all when k is None).

    ``estimator``: 'knn' (nearest neighbours) or 'binned' (exact deciles, one group-by).
    """
    if estimator not in ("knn", "binned"):
        raise ValueError(f"unknown estimator {estimator!r}")
    mi = (mutual_information(df, features, label, problem, bins) if estimator == "binned"
          else mutual_information_knn(df, features, label, problem, key_cols)).collect()
    ranked = sorted(((r["feature"], float(r["mi"])) for r in mi), key=lambda t: (-t[1], t[0]))
    k = len(ranked) if k is None else k
    rows = [(f, v, i + 1, i < k) for i, (f, v) in enumerate(ranked)]
    return df.sparkSession.createDataFrame(rows, "feature string, mi double, rank int, selected boolean")


def auto_select(df: DataFrame, features: list[str], label: str, key_cols: list[str],
                problem: str = "classification", n_noise: int | None = None, reg: float = 0.01,
                seed: int = 7) -> DataFrame:
    """L1 model on standardised features plus seeded noise columns; keep features that beat every noise column."""
    n_noise = n_noise or max(3, len(features))
    st = df.agg(*[F.avg(f).alias(f"{f}__m") for f in features],
                *[F.stddev_samp(f).alias(f"{f}__s") for f in features]).collect()[0]
    key = row_key(key_cols)
    cols = {f: (F.col(f) - F.lit(st[f"{f}__m"])) / F.lit(st[f"{f}__s"] or 1.0) for f in features}
    for i in range(n_noise):
        cols[f"_noise{i}"] = gauss(F.lit(seed), F.lit(i), key)
    d = df.select(*[e.alias(n) for n, e in cols.items()], F.col(label))
    if problem == "classification":
        est = lambda _d, _l: LogisticRegression(regParam=reg, elasticNetParam=1.0, standardization=False)
    else:
        est = lambda _d, _l: LinearRegression(regParam=reg, elasticNetParam=1.0, standardization=False)
    fitted = SparkMLLearner("L1", problem, est).fit(d, list(cols), label)
    m = fitted.last_stage
    coef = (m.coefficientMatrix.toArray()[0] if problem == "classification" and m.numClasses > 2
            else m.coefficients.toArray())
    names = list(cols)
    noise_max = max(abs(float(coef[names.index(f"_noise{i}")])) for i in range(n_noise))
    rows = [(f, float(coef[names.index(f)]), abs(float(coef[names.index(f)])) > noise_max) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, selected boolean")


def rfecv(df: DataFrame, features: list[str], label: str, key_cols: list[str], problem: str = "classification",
          cv: int = 5, step: int = 1, n_trees: int = 100, max_depth: int = 30, seed: int = 7) -> DataFrame:
    """Recursive feature elimination with a random forest, scored by cross-validation.

    Per fold, the weakest feature (forest importance) is dropped step by step
    and every subset is scored on the held-out fold (accuracy or R^2); the
    subset size with the best mean score wins (the smallest on ties) and the
    final elimination runs on all rows.
    """
    from tabloom.operators.forest import RandomForest
    from tabloom.operators.split import kfold, stratified_kfold
    from tabloom.plans.leaderboard import score

    forest = RandomForest("RF", n_trees, max_depth, seed) if problem == "classification" else SparkMLLearner(
        "RF", problem, lambda d, l: RandomForestRegressor(numTrees=n_trees, maxDepth=max_depth, seed=seed))

    folded = (stratified_kfold(df, key_cols, label, cv, seed) if problem == "classification"
              else kfold(df, key_cols, cv, seed)).persist(StorageLevel.MEMORY_AND_DISK)

    def eliminate(train, test=None):
        cur, path = list(features), []
        while cur:
            fitted = forest.fit(train, cur, label)
            s = None
            if test is not None:
                m = score(fitted.transform(test), label, problem, average_over="all")
                s = m["accuracy"] if problem == "classification" else m["r2"]
            path.append((list(cur), s))
            imp = fitted.last_stage.featureImportances.toArray()
            for _ in range(min(step, len(cur))):
                weakest = min(range(len(cur)), key=lambda i: (imp[i], cur[i]))
                cur = cur[:weakest] + cur[weakest + 1:]
                imp = list(imp[:weakest]) + list(imp[weakest + 1:])
        return path

    try:
        scores: dict[int, list[float]] = {}
        for f in range(cv):
            train = folded.where(F.col("fold") != f)
            test = folded.where(F.col("fold") == f)
            for subset, s in eliminate(train, test):
                scores.setdefault(len(subset), []).append(s)
        means = {n: sum(v) / len(v) for n, v in scores.items()}
        best_n = min(means, key=lambda n: (-round(means[n], 12), n))
        final = {len(s): s for s, _ in eliminate(folded)}
    finally:
        folded.unpersist()
    rows = [(n, float(means[n]), ",".join(final[n]), n == best_n) for n in sorted(means)]
    return df.sparkSession.createDataFrame(rows, "n_features int, mean_score double, features string, best boolean")


def selected(features_df: DataFrame, flag: str = "selected", name: str = "feature") -> list[str]:
    return [r[name] for r in features_df.where(F.col(flag)).collect()]


__all__ = ["mutual_information", "mutual_information_knn", "digamma", "select_k_best", "auto_select", "rfecv", "quantile_edges", "selected"]
