"""Searches fitted together, histogram boosting, Shapley values and mutual information against brute force."""
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import batchfit as B
from tabloom.operators import boosting as G
from tabloom.operators import shapley as SH
from tabloom.operators import tune as H
from tabloom.operators.models import learners
from tabloom.sources.tables import f_class

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def frame(spark, sf):
    return f_class(spark, sf).cache()


# ---------------------------------------------------------------- searches

def best_of(df):
    r = df.first()
    return json.loads(r["best_params"]), r["best_score"], r["n_candidates"]


@pytest.mark.parametrize("label,grid", [("y", {"C": [0.001, 1, H.NO_PENALTY], "elasticNetParam": [0.0, 0.5]}),
                                        ("y3", {"C": [0.01, 10], "elasticNetParam": [0.0]})])
def test_logistic_search_agrees_with_the_plain_loop(frame, label, grid):
    args = (frame, FEATS, label, "classification", "Logistic Regression", KEY)
    together, fitted = H.search(*args, folds=2, kind="stratified_kfold", grid=grid)
    one_by_one, _ = H.search(*args, folds=2, kind="stratified_kfold", grid=grid, batch=False)
    a, b = best_of(together), best_of(one_by_one)
    assert a[2] == b[2] and a[1] == pytest.approx(b[1], abs=2e-3)
    if label == "y":
        assert a[0] == b[0]
    assert fitted.transform(frame).count() == frame.count()


def test_logistic_statistics_of_far_rows(spark):
    """Sums against plain formulas, at margins where a probability is 1 to the last bit; blocks stay small."""
    from tabloom.operators import batchfit as B
    rng = np.random.default_rng(9)
    x, y, fold = rng.normal(size=(400, 2)) * 20, rng.integers(0, 2, 400), np.arange(400) % 3
    rows = spark.createDataFrame([(v.tolist(), float(t), int(f)) for v, t, f in zip(x, y, fold)], "x array<double>, y double, fold int").coalesce(1)
    w = rng.normal(size=(4, 1, 3))
    assert B.BLOCK // 4 < B.CELLS // 100
    for (n, loss, g, h), v, out in zip(B._statistics(rows, w, np.array([0, 1, 2, -1]), 2), w[:, 0], (0, 1, 2, -1)):
        own = fold != out
        a = np.column_stack((x, np.ones(400)))[own]
        z, t = a @ v, y[own]
        p = np.where(z >= 0, 1 / (1 + np.exp(-z)), np.exp(z) / (1 + np.exp(z)))
        least = 1 / (2 + np.exp(z) + np.exp(-z))
        assert n == own.sum() and np.isclose(loss, (np.logaddexp(0, z) - t * z).mean(), rtol=1e-12)
        assert np.allclose(g, a.T @ (p - t) / n, rtol=1e-10) and np.allclose(h, (a.T * least) @ a / n, rtol=1e-10)


def test_logistic_fits_reach_the_optimum(spark):
    """Weights against a plain NumPy proximal gradient descent on the same objective."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1, 3, 0.2]
    y = (x @ [1.0, -0.5, 0.0] + rng.normal(size=300) > 0.3).astype(float)
    fold = rng.integers(0, 3, 300)
    rows = spark.createDataFrame([(v.tolist(), float(t), int(f)) for v, t, f in zip(x, y, fold)], "x array<double>, y double, fold int")
    penalties = [(0.0, 0.0), (0.1, 0.0), (0.05, 1.0), (0.2, 0.5)]
    pairs = [(c, f) for c in penalties for f in range(3)]
    got = B.fit_logistic(rows, [c for c, _ in pairs], [f for _, f in pairs], 3, 2)
    for (c, f), w in zip(pairs, got):
        a, t = np.column_stack((x, np.ones(300)))[fold != f], y[fold != f]
        free = np.array([1, 1, 1, 0])
        v, reg = np.zeros(4), c[0]
        step = 1 / (0.25 * np.linalg.eigvalsh(a.T @ a / len(a)).max() + reg)
        for _ in range(60000):
            g = a.T @ (1 / (1 + np.exp(-a @ v)) - t) / len(a) + reg * (1 - c[1]) * v * free
            new = v - step * g
            new = np.where(free, np.sign(new) * np.maximum(np.abs(new) - step * reg * c[1], 0), new)
            if np.abs(new - v).max() < 1e-12:
                break
            v = new
        assert w[0] == pytest.approx(v, abs=1e-5)


def test_linear_search_agrees_with_the_plain_loop(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(
        "p_partkey", (F.col("p_partkey") % 1000).cast("double").alias("x"), F.col("p_size").cast("double").alias("z"),
        (F.col("p_retailprice") + F.col("p_size") * 3 + F.pmod(F.xxhash64("p_partkey"), F.lit(50))).alias("y"))
    for kind in ("kfold", "shuffle_split"):
        grid = {"C": [0.001, H.NO_PENALTY], "elasticNetParam": [0.0, 0.5]}
        args = (p, ["x", "z"], "y", "regression", "Linear Regression", ["p_partkey"])
        a = best_of(H.search(*args, folds=2, kind=kind, grid=grid)[0])
        b = best_of(H.search(*args, folds=2, kind=kind, grid=grid, batch=False)[0])
        assert a[1] == pytest.approx(b[1], rel=1e-3)
        if kind == "shuffle_split":         # hash folds differ in size; the loop takes one size for all of them
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-5)


def test_linear_fit_is_sparks(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) * [1, 5]
    rows = [(*map(float, v), float(v @ [2, -1] + 3 + rng.normal())) for v in x]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    m = B.fold_moments(df.select(F.array("a", "b").alias("x"), "y", F.lit(0).alias("part")), 2)[0]
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    for reg, mix in ((0.0, 0.0), (0.3, 0.0), (0.5, 1.0), (0.4, 0.5)):
        want = LinearRegression(labelCol="y", regParam=reg, elasticNetParam=mix, standardization=False, solver="l-bfgs",
                                maxIter=500, tol=1e-12).fit(vec)
        w, b = B.fit_linear(m, reg, mix)
        assert w == pytest.approx(want.coefficients.toArray(), abs=1e-4) and b == pytest.approx(want.intercept, abs=1e-4)


def test_knn_search_agrees_with_the_plain_loop(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    grid = {"k": [1, 4], "metric": ["manhattan", "minkowski"], "weights": ["uniform", "distance"]}
    args = (emb, ["embedding"], "label", "classification", "KNN", ["vec_id"])
    a = best_of(H.search(*args, folds=2, grid=grid)[0])
    b = best_of(H.search(*args, folds=2, grid=grid, batch=False)[0])
    assert a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2] == b[2]


# ---------------------------------------------------------------- boosting

def brute_tree(x, g, h, spec, depth, edges):
    """Nested (feature, cut, left, right) or leaf value; cuts in ascending order, ties to the first."""
    soft = lambda v: np.sign(v) * max(abs(v) - spec.l1, 0)
    term = lambda m: soft(g[m].sum()) ** 2 / (h[m].sum() + spec.l2)

    def grow(m, d):
        leaf = -soft(g[m].sum()) / (h[m].sum() + spec.l2) * spec.learning_rate
        best = None
        if d:
            for j in range(x.shape[1]):
                for e in edges[j]:
                    left, right = m & (x[:, j] <= e), m & (x[:, j] > e)
                    if not left.any() or not right.any() or min(h[left].sum(), h[right].sum()) < spec.min_child_weight:
                        continue
                    gain = term(left) + term(right) - term(m)
                    if gain > 1e-6 and gain >= spec.gamma and (best is None or gain > best[0] + 1e-9):
                        best = (gain, j, e, left, right)
        if best is None:
            return leaf
        return best[1], best[2], grow(best[3], d - 1), grow(best[4], d - 1)

    return grow(np.ones(len(x), bool), depth)


def nested(tree, edges, node=0):
    if tree.feature[node] < 0:
        return float(tree.value[node])
    return int(tree.feature[node]), float(edges[tree.feature[node]][tree.bin[node]]), nested(tree, edges, 2 * node + 1), \
        nested(tree, edges, 2 * node + 2)


def flat(t):
    return [x for part in t for x in flat(part)] if isinstance(t, tuple) else [t]


@pytest.mark.parametrize("spec", [G.Boost(rounds=3, max_depth=3), G.Boost(rounds=2, max_depth=2, l1=2.0, l2=0.5, gamma=1.0),
                                  G.Boost(rounds=2, max_depth=4, min_child_weight=6.0)])
def test_trees_are_the_brute_force_ones(spark, spec):
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.integers(0, 8, 240), rng.normal(size=240).round(1), rng.integers(0, 2, 240))).astype(float)
    y = (x[:, 0] + 2 * x[:, 1] + rng.normal(size=240) > 4).astype(float)
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double")
    fitted = G.Boosted("b", "classification", spec).fit(df.repartition(3), ["a", "b", "c"], "y")
    forest = fitted.model.forest
    margin = np.full(240, forest.base[0])
    assert forest.base[0] == pytest.approx(math.log(y.mean() / (1 - y.mean())))
    for trees in forest.trees:
        p = 1 / (1 + np.exp(-margin))
        want = brute_tree(x, p - y, p * (1 - p), spec, spec.max_depth, forest.edges)
        got = nested(trees[0], forest.edges)
        assert flat(got) == pytest.approx(flat(want))
        margin = margin + trees[0].value[trees[0].leaves(forest.bins(x), G.MAX_BINS, spec.max_depth)]
    scored = {(r.a, r.b, r.c): r.probability[1] for r in fitted.transform(df).collect()}
    assert all(scored[tuple(v)] == pytest.approx(1 / (1 + math.exp(-m))) for v, m in zip(x, margin))


def test_softmax_boosting_is_one_model_and_its_loss_falls(frame):
    learner = learners("classification")["Gradient Boosting"].inner
    track = []
    fitted = G.Boosted("GB", "classification", G.replace(learner.params, rounds=12)).fit(frame, FEATS, "y3", track)
    loss = [v[0] for v in track]
    assert all(b < a for a, b in zip(loss, loss[1:])) and len(fitted.model.forest.trees[0]) == 3
    out = fitted.transform(frame).select("y3", "prediction", "probability").collect()
    assert all(sum(r.probability) == pytest.approx(1) for r in out)
    assert np.mean([r.y3 == r.prediction for r in out]) > 0.9
    assert loss[-1] == pytest.approx(-np.mean([math.log(r.probability[r.y3]) for r in out]), rel=1e-9)


def test_boosting_handles_missing_values_and_subsamples(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 3 == 0 else float(i % 7), float(rng.normal()), 10.0 if i % 3 == 0 else float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fitted = G.Boosted("b", "regression", G.Boost(rounds=30)).fit(df, ["a", "b"], "y")
    err = fitted.transform(df).select(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert err < 0.1 and fitted.model.featureImportances[0] > 0.9
    spec = G.Boost(rounds=10, subsample=0.6, colsample=0.5, seed=4)
    a, b = (G.Boosted("b", "regression", spec).fit(df.repartition(n), ["a", "b"], "y").model.forest for n in (2, 5))
    x = np.array([[1.0, 0.0], [np.nan, 1.0], [6.0, -1.0]])
    assert a.margins(x) == pytest.approx(b.margins(x)) and len({int(t[0].feature[0]) for t in a.trees}) == 2
    empty = G.Boosted("b", "regression", G.Boost(rounds=2)).fit(df.limit(0), ["a", "b"], "y")
    assert empty.transform(df).select("prediction").distinct().count() == 1


def test_models_fitted_together_equal_those_fitted_alone(frame):
    specs = [G.Boost(rounds=4, max_depth=2), G.Boost(rounds=6, max_depth=4, l1=1.0, subsample=0.7)]
    edges = G.bin_edges(frame, FEATS)
    base = np.array([-1.0])
    key = F.xxhash64(*KEY)
    fold = F.pmod(key, F.lit(2))

    def fit(which, folds):
        state = G.binned(frame, FEATS, F.col("y"), fold, key, edges, np.tile(base, len(which)))
        return G.fit_many(state, which, folds, edges, "logistic", 1, base)

    both = fit([specs[0], specs[1], specs[0]], [0, 1, -1])
    x = np.random.default_rng(0).random((50, 3))
    for k, (s, f) in enumerate(((specs[0], 0), (specs[1], 1), (specs[0], -1))):
        assert both[k].margins(x) == pytest.approx(fit([s], [f])[0].margins(x))
    # the same in groups of one
    whole, G.MAX_STATS = G.MAX_STATS, 1
    try:
        assert [m.margins(x).tolist() for m in fit(specs, [0, 1])] == [m.margins(x).tolist() for m in both[:2]]
    finally:
        G.MAX_STATS = whole


def test_fourier_features_of_far_points():
    """Reduced angles: as exact far from the origin as near it."""
    from tabloom.operators import kernel as K
    w, b = K.directions(3, 64, 2)
    x = np.random.default_rng(5).normal(size=(700, 3)) * np.array([1.0, 1e2, 1e4])
    want = math.sqrt(2 / 64) * np.cos(x @ (w * math.sqrt(2 * 0.7)) + b)
    got = K.fourier(x, 0.7, w, b)
    assert np.abs(got[:, :-1] - want).max() < 1e-6 and (got[:, -1] == 1).all()


def test_kernel_rows_on_all_cores(spark, frame, monkeypatch):
    """One file partition does not stay one task of every iteration."""
    from tabloom.operators import kernel as K
    seen = []
    whole = K.fit_machines
    monkeypatch.setattr(K, "fit_machines", lambda rows, *a, **k: (seen.append(rows.rdd.glom().map(len).collect()), whole(rows, *a, **{**k, "max_iter": 1}))[1])
    K.KernelMachine("classification").fit(frame.coalesce(1), FEATS, "y")
    assert sum(n > 0 for n in seen[0]) > 1 and sum(seen[0]) == frame.count()


def test_adaboost_rows_on_all_cores(frame, monkeypatch):
    """One file partition does not stay one task of every round."""
    from tabloom.operators import models as M
    seen, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: (seen.append(df.rdd.glom().map(len).collect()), cut(df))[1])
    M.AdaBoost("classification", n_estimators=2).fit(frame.coalesce(1), FEATS, "y")
    assert sum(n > 0 for n in seen[0]) > 1 and sum(seen[0]) == frame.count()


def test_boosting_state_is_blocks_on_all_cores(spark, frame):
    """One file partition does not stay one task, and a task reads blocks, not rows."""
    edges = G.bin_edges(frame, FEATS)
    state = G.binned(frame.coalesce(1), FEATS, F.col("y"), F.lit(0), F.xxhash64(*KEY), edges, np.zeros(1))
    parts = state.rdd.glom().map(len).collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and sum(n > 0 for n in parts) > 1
    assert sum(parts) <= len(parts) + frame.count() / 10_000
    rows = state.rdd.flatMap(lambda r: np.frombuffer(r["y"], np.float64).tolist()).collect()
    assert sorted(rows) == sorted(float(r.y) for r in frame.select("y").collect())


def test_leaves_of_a_tree_row_by_row():
    rng = np.random.default_rng(3)
    t = G.Tree.empty(3)
    t.feature[[0, 1, 2, 4, 5]], t.bin[[0, 1, 2, 4, 5]] = [1, 0, 2, 2, 1], [9, 4, 7, 2, 14]
    t.missing_left[[1, 4]] = True
    bins = rng.integers(0, 20, (400, 3)).astype(np.uint8)
    bins[rng.random((400, 3)) < 0.2] = G.MAX_BINS
    for levels in range(4):
        want = []
        for b in bins:
            n = 0
            for _ in range(levels):
                if t.feature[n] >= 0:
                    v = b[t.feature[n]]
                    n = 2 * n + (1 if (t.missing_left[n] if v == G.MAX_BINS else v <= t.bin[n]) else 2)
            want.append(n)
        assert t.leaves(bins, G.MAX_BINS, levels).tolist() == want


def test_paths_of_a_tree_by_lookup():
    """The same nodes as a walk, whether the table holds all levels, some or none; missing values included."""
    rng = np.random.default_rng(11)
    tree = G.Tree.empty(5)
    for node in range(31):
        if node == 0 or (tree.feature[(node - 1) // 2] >= 0 and rng.random() < 0.8):
            tree.feature[node], tree.bin[node], tree.missing_left[node] = rng.integers(3), rng.integers(40), rng.random() < 0.5
    bins = rng.integers(0, 42, (4000, 3)).astype(np.uint8)
    bins[rng.random(bins.shape) < 0.1] = 255
    values = rng.normal(size=63)
    columns = [bins[:, j].astype(np.intp) for j in range(3)]
    tops = set()
    for size in (1, 30, 200, 10 ** 6):
        for levels in (1, 3, 5):
            paths = G.Paths(tree, levels, values, 255, size)
            tops.add(levels - paths.rest)
            assert (paths(columns) == values[tree.leaves(bins, 255, levels)]).all()
    assert {0, 5} < tops


def test_a_level_counts_one_of_two_siblings(spark, monkeypatch):
    """No node's histograms are counted where its sibling's and its parent's are known; the trees are the same."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 30, (700, 2)).astype(float)
    d = spark.createDataFrame([(*v.tolist(), float(v[0] > v[1] + 5 * e)) for v, e in zip(x, rng.normal(size=700))], "a double, b double, y double")
    learner = G.Boosted("b", "classification", G.Boost(rounds=3, max_depth=4))
    counted, count = [], G._histograms

    def seen(state, specs, folds, trees, at, level, *rest):
        counted.append((level, sum(len(v) for v in at.values())))
        return count(state, specs, folds, trees, at, level, *rest)

    monkeypatch.setattr(G, "_histograms", seen)
    half = learner.fit(d, ["a", "b"], "y").model.forest
    assert {n for level, n in counted if level == 1} == {1} and max(n for _, n in counted) <= 4
    monkeypatch.setattr(G, "SAFE_L2", float("inf"))
    whole = learner.fit(d, ["a", "b"], "y").model.forest
    for one, two in zip(half.trees, whole.trees):
        assert (one[0].feature == two[0].feature).all() and (one[0].cover == two[0].cover).all()
        assert np.allclose(one[0].value, two[0].value, atol=1e-9)


def test_store_keeps_boosted_models(spark, frame):
    from tabloom.session import scratch_path
    from tabloom.sources import store
    fitted = G.Boosted("b", "classification", G.Boost(rounds=3)).fit(frame, FEATS, "y3")
    path = scratch_path(spark, "boosted")
    store.save_model(spark, fitted, path)
    again = store.load_model(spark, path)
    cols = [*KEY, "prediction", F.col("probability").cast("string").alias("p")]
    assert fitted.transform(frame).select(*cols).exceptAll(again.transform(frame).select(*cols)).count() == 0


# ---------------------------------------------------------------- Shapley values

def subset_values(f, p):
    """Shapley values from the values of all subsets."""
    out = np.zeros(p)
    for j in range(p):
        others = [k for k in range(p) if k != j]
        for size in range(p):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
                out[j] += w * (f(frozenset(s) | {j}) - f(frozenset(s)))
    return out


def walk(tree, node, x, known):
    """Mean output of a tree where features outside ``known`` follow both branches by row share."""
    left, right, feature, cut, cover, value = tree
    if left[node] < 0:
        return value[node]
    if feature[node] in known:
        return walk(tree, left[node] if x[feature[node]] <= cut[node] else right[node], x, known)
    return sum(cover[c] / cover[node] * walk(tree, c, x, known) for c in (left[node], right[node]))


def test_tree_paths_against_all_subsets():
    rng = np.random.default_rng(9)
    p = 5
    trees = []
    total = SH.TreeSum(p)
    for _ in range(4):
        left, right, feature, cut, cover, value = [-1], [-1], [0], [0.0], [1000.0], [0.0]
        queue = [(0, 0)]
        while queue:
            node, d = queue.pop()
            if d < 6 and cover[node] > 4 and (d < 2 or rng.random() < 0.7):
                feature[node], cut[node] = int(rng.integers(p)), float(rng.normal())
                share = float(rng.integers(1, int(cover[node])))
                for kids, c in ((left, share), (right, cover[node] - share)):
                    kids[node] = len(left)
                    for a, v in ((left, -1), (right, -1), (feature, 0), (cut, 0.0), (cover, c), (value, float(rng.normal()))):
                        a.append(v)
                    queue.append((kids[node], d + 1))
        trees.append((left, right, feature, cut, cover, value))
        total.add(left, right, feature, cut, cover, value, weight=0.5)
    x = rng.normal(size=(20, p))
    got = SH.path_values(total.groups(), x)
    for row, values in zip(x, got):
        f = lambda s: 0.5 * sum(walk(t, 0, row, s) for t in trees)  # noqa: B023, E731
        assert values == pytest.approx(subset_values(f, p), abs=1e-10)
        assert values.sum() == pytest.approx(f(frozenset(range(p))) - total.base(), abs=1e-10)


def sums(df, key, output):
    got = df.groupBy(*key).agg(F.sum("shap").alias("s"))
    return {tuple(r[k] for k in key): r["s"] for r in got.collect()}, output


@pytest.mark.parametrize("name", ["Decision Tree", "Random Forest", "Gradient Boosting", "XGB"])
def test_tree_models_add_up_to_their_output(spark, frame, name):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from tabloom.operators.models import SparkMLLearner
    d = frame.dropDuplicates(KEY).limit(400).cache()
    if name == "Random Forest":
        fitted = SparkMLLearner(name, "classification", lambda d, l: RandomForestClassifier(numTrees=5, seed=1)).fit(frame, FEATS, "y")
    elif name == "Gradient Boosting":
        fitted = SparkMLLearner(name, "classification", lambda d, l: GBTClassifier(maxIter=4, maxDepth=3, seed=1)).fit(frame, FEATS, "y")
    elif name == "XGB":
        fitted = G.Boosted(name, "classification", G.Boost(rounds=5)).fit(frame, FEATS, "y")
    else:
        fitted = learners("classification")[name].fit(frame, FEATS, "y")
    got = {tuple(r[k] for k in KEY): r["s"] for r in
           SH.shap_tree(fitted, d, KEY, 1).groupBy(*KEY).agg(F.sum("shap").alias("s")).collect()}
    base = SH.tree_base(fitted, spark, 1)
    assert len(got) == d.count()
    for r in fitted.transform(d).select(*KEY, vector_to_array("probability")[1].alias("p")).collect():
        p = min(max(r["p"], 1e-15), 1 - 1e-15)
        want = p if name in ("Decision Tree", "Random Forest") else math.log(p / (1 - p)) / (2 if name == "Gradient Boosting" else 1)
        assert got[tuple(r[k] for k in KEY)] + base == pytest.approx(want, abs=1e-8)


def test_kernel_solution_is_exact_with_all_subsets():
    rng = np.random.default_rng(2)
    for p in (1, 2, 3, 6):
        subsets, weights = SH.kernel_subsets(p)
        assert len(subsets) == 2 ** p - 2
        matrix = SH.kernel_solution(subsets.reshape(-1, p), weights, p)
        table = {frozenset(np.flatnonzero(m).tolist()): rng.normal() for m in itertools.product((0, 1), repeat=p)}
        base = table[frozenset()]
        y = np.array([table[frozenset(np.flatnonzero(s).tolist())] for s in subsets] + [table[frozenset(range(p))]]) - base
        assert matrix @ y == pytest.approx(subset_values(table.__getitem__, p), abs=1e-9)
    subsets, weights = SH.kernel_subsets(16, limit=400)
    assert len(subsets) <= 400 and len({tuple(s) for s in subsets}) == len(subsets) and (weights > 0).all()
    assert {tuple(s) for s in subsets} == {tuple(1 - s) for s in subsets}


def test_kernel_values_against_all_subsets(spark, frame):
    fitted = learners("classification")["Gaussian NB"].fit(frame, FEATS, "y")
    d = frame.dropDuplicates(KEY).limit(6).cache()
    centres, share = SH.background_centres(frame, FEATS, 4, 7)
    assert sum(share) == pytest.approx(1)
    got = {}
    for r in SH.shap_kernel(fitted, d, KEY, frame, 4, 1).collect():
        got.setdefault(tuple(r[k] for k in KEY), {})[r.feature] = r.shap
    for r in d.collect():
        own = [r[f] for f in FEATS]
        points = [(i, c, [own[j] if m >> j & 1 else centres[c][j] for j in range(3)]) for i, m in enumerate(range(8)) for c in range(4)]
        scored = fitted.transform(spark.createDataFrame([(m, c, *map(float, v)) for m, c, v in points], "m int, c int, x1 double, x2 double, x3 double"))
        table = {}
        for s in scored.collect():
            table[s.m] = table.get(s.m, 0) + share[s.c] * s.probability[1]
        want = subset_values(lambda s: table[sum(1 << j for j in s)], 3)
        assert [got[tuple(r[k] for k in KEY)][f] for f in FEATS] == pytest.approx(want, abs=1e-9)


def test_shap_values_choose_the_rule(spark, sf, frame):
    from tabloom.operators import explain as X
    from tabloom.operators.knn import KNNLearner
    d = frame.dropDuplicates(KEY).limit(5).cache()
    train = frame.dropDuplicates(KEY).cache()
    knn = KNNLearner("classification", key_cols=KEY).fit(train, FEATS, "y")
    tree = learners("classification")["Decision Tree"].fit(frame, FEATS, "y")
    logistic = learners("classification")["Logistic Regression"].fit(frame, FEATS, "y")
    for fitted in (knn, tree, logistic):
        got = X.shap_values(fitted, d, KEY, frame, 1, n_centres=3)
        assert got.columns == [*KEY, "feature", "shap"] and got.count() == 15
    p = {tuple(r[k] for k in KEY): r.probability[1] for r in knn.transform(d).collect()}
    s = {tuple(r[k] for k in KEY): r.s for r in X.shap_values(knn, d, KEY, frame, 1, n_centres=3).groupBy(*KEY).agg(F.sum("shap").alias("s")).collect()}
    gaps = {round(p[k] - s[k], 9) for k in p}
    assert len(gaps) == 1       # one base value for all rows


# ---------------------------------------------------------------- mutual information

def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def ross(x, y, k=3):
    many = [c for c in set(y) if y.count(c) > 1]
    keep = [i for i in range(len(x)) if y[i] in many]
    xs, ys = np.array([x[i] for i in keep]), [y[i] for i in keep]
    s = 0.0
    for i in range(len(xs)):
        own = np.sort(np.abs(xs[[j for j in range(len(xs)) if ys[j] == ys[i] and j != i]] - xs[i]))
        kk = min(k, len(own))
        m = int((np.abs(xs - xs[i]) <= own[kk - 1] * (1 - 1e-10)).sum())
        s += psi(kk) - psi(len(own) + 1) - psi(m)
    return max(0.0, psi(len(xs)) + s / len(xs))


def test_mutual_information_against_brute_force(spark):
    from tabloom.operators.select import mutual_information_knn
    rng = np.random.default_rng(4)
    n = 400
    y = [str(v) for v in rng.integers(0, 3, n)]
    y[5], y[6] = "alone", "pair"
    y[7] = "pair"
    feats = {"smooth": rng.normal(size=n) + [2.0 * (c == "1") for c in y], "ties": rng.integers(0, 6, n).astype(float),
             "half": np.where(rng.random(n) < .5, 1.0, rng.normal(size=n)), "grid": rng.integers(0, 400, n) / 10.0}
    df = spark.createDataFrame([(i, y[i], *(float(v[i]) for v in feats.values())) for i in range(n)],
                               "id long, y string, " + ", ".join(f"{f} double" for f in feats))
    got = {r.feature: r.mi for r in mutual_information_knn(df.repartition(5), list(feats), "y").collect()}
    assert got == pytest.approx({f: ross(v.tolist(), y) for f, v in feats.items()}, abs=1e-9)


def test_numeric_mutual_information_against_brute_force(spark):
    from tabloom.operators.select import mutual_information_knn
    rng = np.random.default_rng(7)
    n = 300
    a = rng.normal(size=n)
    feats = {"near": a + rng.normal(size=n) * .3, "noise": rng.normal(size=n), "ties": np.round(a)}
    df = spark.createDataFrame([(i, float(a[i]), *(float(v[i]) for v in feats.values())) for i in range(n)],
                               "id long, y double, " + ", ".join(f"{f} double" for f in feats))
    got = {r.feature: r.mi for r in mutual_information_knn(df, list(feats), "y", "regression", ["id"]).collect()}
    for f, v in feats.items():
        x, y = v / v.std(), a / a.std()
        s = 0.0
        for i in range(n):
            d = np.maximum(np.abs(x - x[i]), np.abs(y - y[i]))
            r = np.sort(np.delete(d, i))[2] * (1 - 1e-10)
            s += psi(int((np.abs(x - x[i]) <= r).sum())) + psi(int((np.abs(y - y[i]) <= r).sum()))
        assert got[f] == pytest.approx(max(0.0, psi(n) + psi(3) - s / n), abs=1e-9)


def test_digamma(spark):
    from tabloom.operators.select import digamma
    got = spark.range(1, 3000).select(digamma(F.col("id")).alias("v")).collect()
    assert [r.v for r in got] == pytest.approx([psi(k) for k in range(1, 3000)], abs=1e-13)


# ---------------------------------------------------------------- correlated Shapley values, shuffles, counts

def test_correlated_linear_values_against_all_subsets():
    from tabloom.operators.explain import correlated_transform
    rng = np.random.default_rng(6)
    a = rng.normal(size=(4, 4))
    cov, coef, x = a @ a.T, rng.normal(size=4), rng.normal(size=4)

    def value(s):
        s = sorted(s)
        full = cov[:, s] @ np.linalg.inv(cov[np.ix_(s, s)]) @ x[s] if s else np.zeros(4)
        return coef @ full

    want = subset_values(value, 4)
    assert correlated_transform(coef, cov) @ x == pytest.approx(want)
    sampled = correlated_transform(coef, cov, max_exact=2, orders=4000) @ x
    assert sampled == pytest.approx(want, abs=0.2) and sampled.sum() == pytest.approx(want.sum())
    assert correlated_transform(coef, np.diag([1.0, 2, 3, 4])) == pytest.approx(np.diag(coef))


def test_keyed_permutations(spark):
    from tabloom.functions.exprs import keyed_permutation
    for n in (1, 2, 3, 17, 100, 1000):
        rows = spark.range(n).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
        got = rows.select("id", "k", keyed_permutation(F.col("id"), n, F.lit(9), F.col("k")).alias("p")).collect()
        orders = {}
        for r in got:
            orders.setdefault(r.k, {})[r.id] = r.p
        assert all(sorted(o.values()) == list(range(n)) for o in orders.values())
        assert n < 17 or len({tuple(o[i] for i in range(n)) for o in orders.values()}) == 4


def test_permutations_walk_only_where_outside(spark):
    """The walk of 64 steps stands behind a condition; the values are those of walking every one."""
    from tabloom.functions.exprs import keyed_permutation
    rows = spark.range(97).select(keyed_permutation(F.col("id"), 97, F.lit(9), F.lit(3)).alias("p"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.index("CASE WHEN (lambda") < plan.index("sequence(1, 64")


def test_shuffles_are_dealt_over_the_cores(spark, monkeypatch):
    """The few rows of a fold are spread before each becomes many points."""
    from tabloom.operators import explain as X
    dealt = []
    spread = X.spread
    monkeypatch.setattr(X, "spread", lambda d: dealt.append(spread(d)) or dealt[-1])
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 7 + i % 5)) for i in range(60)], "id long, a double, b double, y double")
    from tabloom.operators.models import learners
    X.permutation_importance(learners("regression")["Linear Regression"], df, ["a", "b"], "y", "regression", ["id"], folds=2, repeats=3)
    assert [d.rdd.getNumPartitions() for d in dealt] == [spark.sparkContext.defaultParallelism] * 2


def test_permutation_importance_of_a_known_model(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(3 * a + 0 * b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    from tabloom.operators.explain import permutation_importance
    got = {r.feature: r for r in permutation_importance(learners("regression")["Linear Regression"], df, ["a", "b"], "y",
                                                        "regression", ["id"], folds=3, repeats=30).collect()}
    # a shuffled feature that is all of y: R^2 falls from 1 to about -1
    assert got["a"].importance_mean == pytest.approx(2, abs=0.1) and got["a"].importance_std > 0
    assert got["b"].importance_mean == pytest.approx(0, abs=1e-9)


def test_distinct_counts_without_copies(spark):
    from tabloom.operators.profile import column_list, problem_types
    df = spark.createDataFrame([(0.0, "a", None, bytearray(b"1"), [1]), (-0.0, "a", 1, bytearray(b"1"), [1]),
                                (float("nan"), "b", 1, None, [2]), (float("nan"), "", 2, bytearray(b""), None)],
                               "d double, s string, i int, b binary, l array<int>")
    got = {r["column"]: (r["distinct"], r["missing"]) for r in column_list(df).collect()}
    assert got == {"d": (2, 0), "s": (3, 0), "i": (2, 1), "b": (2, 1), "l": (2, 1)}
    assert {r["column"]: r["n_unique"] for r in problem_types(df).collect()} == {"d": 2, "s": 3, "i": 3, "b": 3, "l": 3}
    assert {r["distinct"] for r in column_list(df.limit(0)).collect()} == {0}


def test_saved_recipe_stands_without_the_scratch_folder(spark, tmp_path, monkeypatch):
    from tabloom.operators import transform as TR
    from tabloom.plans.recipe import Recipe
    df = spark.createDataFrame([(f"name {i:04}", i) for i in range(1500)], "s string, i int")
    r = Recipe().stage("label_encode", ["s"]).fit(df)
    assert r.steps[0].params["tables"]["s"]
    path = str(tmp_path / "one" / "recipe")
    r.save(spark, path)
    text = spark.read.text(path).first()[0]
    assert "ckpt" not in text and "tabloom-test" not in text and TR.PLAN_CATEGORIES < 1500
    moved = tmp_path / "two"
    (tmp_path / "one").rename(moved)
    want = r.transform(df, project=False).collect()
    assert Recipe.load(spark, str(moved / "recipe")).transform(df, project=False).collect() == want


# ---------------------------------------------------------------- kernel machines

def test_fourier_features_estimate_the_kernel():
    from tabloom.operators import kernel as K
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    for gamma in (0.05, 0.5):
        w, b = K.directions(3, 2048, 1)
        phi = K.fourier(x, gamma, w, b)[:, :-1]
        want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
        assert np.abs(phi @ phi.T - want).max() < 5 / math.sqrt(2048)


def test_kernel_machines_fit_what_no_line_does(spark):
    from tabloom.operators import kernel as K
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (500, 2))
    ring, wave = ((x ** 2).sum(1) < 1.5).astype(int), np.sin(2 * x[:, 0]) + 0.5 * x[:, 1]
    three = np.where(x[:, 0] * x[:, 1] > 0.5, 2, ring)
    df = spark.createDataFrame([(i, *map(float, v), int(r), int(t), float(y)) for i, (v, r, t, y) in enumerate(zip(x, ring, three, wave))],
                               "id long, a double, b double, ring int, three int, wave double").cache()
    for label, least in (("ring", 0.95), ("three", 0.9)):
        out = K.KernelMachine("classification", c=10.0).fit(df, ["a", "b"], label).transform(df)
        assert out.where(F.col("prediction") == F.col(label)).count() / 500 > least
    svr = K.KernelMachine("regression", c=10.0, epsilon=0.02).fit(df, ["a", "b"], "wave").transform(df)
    assert svr.select(F.avg(F.abs(F.col("wave") - F.col("prediction")))).first()[0] < 0.06
    out, fitted = H.search(df, ["a", "b"], "ring", "classification", "SVC", ["id"], folds=2, grid={"C": [0.01, 10], "gamma": [0.01, 1]})
    assert out.first()["best_score"] > 0.97 and json.loads(out.first()["best_params"]) == {"C": 10, "gamma": 1}
    assert fitted.transform(df).where("prediction = ring").count() > 470


def test_kernel_passes_read_blocks(spark, monkeypatch):
    """An iteration reads blocks of rows, held once, and leaves nothing held behind."""
    from tabloom.operators import kernel as K
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(v.tolist(), float(v[0] * v[1] > 0), 0) for v in rng.normal(size=(900, 2))],
                                 "x array<double>, y double, fold int").coalesce(2)
    seen, whole = [], K.block_sum
    monkeypatch.setattr(K, "block_sum", lambda blocks, *a: (seen.append((blocks.id(), blocks.count(), blocks.is_cached)), whole(blocks, *a))[1])
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    K.fit_machines(rows, [K.Machine(1.0, 0.5, -1, 1)], 2, n_features=16, max_iter=3)
    assert len(seen) > 2 and len({one[0] for one in seen}) == 1
    assert all(n <= 2 and held for _, n, held in seen)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_a_row_has_the_same_waves_in_any_block():
    from tabloom.operators import kernel as K
    w, b = K.directions(3, 32, 1)
    x = np.random.default_rng(2).normal(size=(300, 3))
    x[::7] *= 1e4
    whole, wave = K.fourier(x, 0.4, w, b), K.Waves(0.4, w, b, 300, 3)
    assert all(np.allclose(wave(x[i:i + 1])[0], whole[i], atol=1e-6, rtol=0) for i in range(len(x)))
    weights = np.random.default_rng(3).normal(size=(2, 33))
    assert np.allclose(K.Waves(0.4, w, b, 37, 3).products(x, weights), whole @ weights.T, atol=1e-5)


def test_machines_reach_the_optimum(spark):
    """Objective values against plain subgradient-free descent in NumPy on the same features."""
    from tabloom.operators import kernel as K
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(120, 2)), rng.integers(0, 2, 120).astype(float)
    rows = spark.createDataFrame([(v.tolist(), float(t), i % 2) for i, (v, t) in enumerate(zip(x, y))], "x array<double>, y double, fold int")
    machines = [K.Machine(c, g, f, k) for c in (0.1, 5.0) for g in (0.2, 1.0) for f in (-1, 0) for k in (1, None)]
    got = K.fit_machines(rows, machines, 2, n_features=20, max_iter=500, tol=1e-8)
    w0, b0 = K.directions(2, 20, 0)
    for one, w in zip(machines, got):
        use = np.arange(120) % 2 != one.fold
        phi, t = K.fourier(x, one.gamma, w0, b0)[use], y[use]

        def f(v):
            loss, s = K._loss(phi @ v, t, one.positive, 0.1)
            flat = np.append(v[:-1], 0) / (one.c * len(t))
            return loss.mean() + flat @ v / 2, phi.T @ s / len(t) + flat

        v = np.zeros(21)
        step = 1 / (np.linalg.eigvalsh(phi.T @ phi / len(t)).max() / K.ROUND + 1 / (one.c * len(t)))
        z, k = v, 1.0
        for _ in range(4000):       # accelerated descent
            new = z - step * f(z)[1]
            nk = (1 + math.sqrt(1 + 4 * k * k)) / 2
            z, v, k = new + (k - 1) / nk * (new - v), new, nk
        assert f(w)[0] <= f(v)[0] + 1e-5


# ---------------------------------------------------------------- LIME on bins

def brute_surrogate(z, y, w, num_features, alpha):
    def ridge(cols, a):
        x = z[:, cols]
        xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
        m = ((x - xm) * w[:, None]).T @ (x - xm) + a * np.eye(len(cols))
        c = np.linalg.pinv(m) @ (((x - xm) * w[:, None]).T @ (y - ym))
        return c, ym - xm @ c

    p, chosen = z.shape[1], []
    if num_features >= p:
        chosen = list(range(p))
    elif num_features <= 6:
        for _ in range(num_features):
            def left(f):
                c, b = ridge(chosen + [f], 0.0)
                return round(float((w * (y - z[:, chosen + [f]] @ c - b) ** 2).sum()), 9)
            chosen.append(min((f for f in range(p) if f not in chosen), key=left))
    else:
        chosen = sorted(np.argsort(-np.abs(ridge(list(range(p)), 0.01)[0]), kind="stable")[:num_features].tolist())
    c, b = ridge(chosen, alpha)
    out = np.zeros(p)
    out[chosen] = c
    return out, b


def test_surrogates_match_numpy_per_row():
    from tabloom.operators.explain import surrogate
    rng = np.random.default_rng(2)
    for p, k in ((3, 10), (5, 2), (9, 7), (8, 3)):
        sums, want = [], []
        for _ in range(6):
            z = rng.integers(0, 2, (200, p)).astype(float)
            y = z @ rng.normal(size=p) + rng.normal(size=200) * .1
            w = rng.random(200) + .1
            i, j = np.triu_indices(p)
            sums.append(np.concatenate(([w.sum()], w @ z, [w @ y], (w * y) @ z, (w[:, None] * z[:, i] * z[:, j]).sum(0))))
            want.append(brute_surrogate(z, y, w, k, 1.0))
        coef, intercept = surrogate(np.array(sums), p, k, 1.0)
        assert coef == pytest.approx(np.array([c for c, _ in want]), abs=1e-8)
        assert intercept == pytest.approx(np.array([b for _, b in want]), abs=1e-8)


def test_binned_lime(spark, frame):
    from tabloom.operators import explain as X
    bins = X.lime_bins(frame, FEATS)
    assert all(sum(b["share"] for b in bins[f]["bins"]) == pytest.approx(1) for f in FEATS)
    place, value = X.lime_sample(bins, "x1", F.lit(1), F.col("id"))
    got = spark.range(8000).select(place.alias("b"), value.alias("v")).groupBy("b").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m")).collect()
    for r in got:
        one = bins["x1"]["bins"][r.b]
        assert r.n / 8000 == pytest.approx(one["share"], abs=0.03)
        assert one["lo"] <= r.lo <= r.hi <= one["hi"] and r.m == pytest.approx(one["m"], abs=0.05)
    fitted = learners("classification")["Logistic Regression"].fit(frame, FEATS, "y")
    d = frame.dropDuplicates(KEY).limit(4).cache()
    out = X.lime_binned(fitted, d, KEY, frame, n_samples=400, class_index=1).collect()
    again = X.lime_binned(fitted, d.repartition(3), KEY, frame, n_samples=400, class_index=1).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len({tuple(r[k] for k in KEY) for r in out}) == 4
    assert all(r.feature in r.rule for r in out)
    one = X.lime_binned(fitted, d, KEY, frame, n_samples=400, num_features=1, class_index=1).collect()
    assert len(one) == 4 and {r.feature for r in one} <= {"x1", "x2"}      # x3 is noise


def test_wide_correlations_keep_their_digits(spark):
    """More columns than one aggregate takes; the first rows say nothing about the rest."""
    from tabloom.operators.profile import CENTRE_ROWS, corr_matrix
    rng = np.random.default_rng(3)
    n, p = 3000, 20
    v = rng.normal(size=(n, p))
    v[:, 1] += v[:, 0]
    v[:CENTRE_ROWS, 2] = 0.0
    v[CENTRE_ROWS:, 2] += 1e9          # far from what the first rows show
    v[:, 3] = 7.0
    miss = rng.random((n, p)) < 0.2
    rows = [tuple(None if m else float(x) for x, m in zip(r, q)) for r, q in zip(v, miss)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(p))).coalesce(1)
    got = {(r.col_a, r.col_b): r["corr"] for r in corr_matrix(df).collect()}
    for i, j in ((0, 1), (1, 2), (0, 2), (4, 5), (2, 2), (0, 3)):
        both = ~miss[:, i] & ~miss[:, j]
        want = None if 3 in (i, j) else np.corrcoef(v[both, i], v[both, j])[0, 1]
        assert got[f"c{i}", f"c{j}"] == (None if want is None else pytest.approx(want, abs=1e-6))
