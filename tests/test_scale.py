"""Binned forests, searches over trees, LIME sums and hashed row numbers against the plainer way."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import scan
from tabloom.operators import explain as X
from tabloom.operators import forest as T
from tabloom.operators import shapley as SH
from tabloom.operators import split as S
from tabloom.operators import tune as H
from tabloom.operators.models import SparkMLLearner, learners
from tabloom.plans.leaderboard import score

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3)).round(2)
    y = (2 * x[:, 0] + x[:, 1] + rng.normal(size=3000) > 0.3).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, y int").cache()


def test_cuts_are_those_of_sparks_trees(spark, rows):
    x = np.array([[r.a, r.b, r.c] for r in rows.collect()])
    cuts = T.cut_values(rows.select(T.feature_values(FEATS).alias("x")), 3)
    model = SparkMLLearner("RF", "classification", lambda d, l: T.RandomForestClassifier(numTrees=20, maxDepth=10, seed=1)).fit(rows, FEATS, "y")
    from tabloom.session import scratch_path
    path = scratch_path(spark, "t")
    model.last_stage.write().overwrite().save(path)
    used = spark.read.parquet(f"{path}/data").select("nodeData.*").where("leftChild >= 0").select(
        "split.featureIndex", F.col("split.leftCategoriesOrThreshold")[0].alias("t")).collect()
    assert used and all(np.isclose(cuts[r.featureIndex], r.t, atol=1e-12).any() for r in used)
    # more different values than are counted one by one: exact quantiles
    few, T.MAX_VALUES = T.MAX_VALUES, 50
    try:
        wide = T.cut_values(rows.select(T.feature_values(FEATS).alias("x")), 3)
    finally:
        T.MAX_VALUES = few
    for j in range(3):
        share = np.array([(x[:, j] <= c).mean() for c in wide[j]])
        assert len(wide[j]) == 31 and np.abs(share - np.arange(1, 32) / 32).max() < 0.02


def test_forest_of_cells_is_a_random_forest(spark, rows, tmp_path):
    from tabloom.sources.store import load_model, save_model
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    learner = learners("classification")["Random Forest"]
    fitted = learner.fit(train, FEATS, "y")
    assert isinstance(fitted.last_stage, T.ForestPayload) and len(fitted.last_stage.trees) == 100
    plain = SparkMLLearner("RF", "classification", lambda d, l: T.RandomForestClassifier(numTrees=100, maxDepth=30, seed=7)).fit(train, FEATS, "y")
    a, b = (score(m.transform(test), "y", "classification") for m in (fitted, plain))
    assert a["accuracy"] == pytest.approx(b["accuracy"], abs=0.03)
    assert fitted.last_stage.featureImportances.toArray() == pytest.approx(plain.last_stage.featureImportances.toArray(), abs=0.03)
    again = learner.fit(train.repartition(5), FEATS, "y")
    want = {r.id: (r.prediction, r.probability) for r in fitted.transform(test).collect()}
    save_model(spark, fitted, str(tmp_path / "m"))
    for other in (again, load_model(spark, str(tmp_path / "m"))):
        assert {r.id: (r.prediction, r.probability) for r in other.transform(test).collect()} == want
    few = test.limit(20).cache()
    got = {r.id: r.s for r in SH.shap_tree(fitted, few, ["id"], 1).groupBy("id").agg(F.sum("shap").alias("s")).collect()}
    base = SH.tree_base(fitted, spark, 1)
    for r in few.collect():
        assert got[r.id] + base == pytest.approx(want[r.id][1][1], abs=1e-8)


def test_forest_refuses_missing_values_and_leaves_many_cells_to_spark(rows, monkeypatch):
    learner = learners("classification")["Random Forest"]
    with pytest.raises(Exception, match="a is missing"):
        learner.fit(rows.withColumn("a", F.when(F.col("id") > 5, F.col("a"))), FEATS, "y")
    monkeypatch.setattr(T, "MAX_CELLS", 10)
    fitted = T.RandomForest(n_trees=3, max_depth=4).fit(rows, FEATS, "y")
    assert not isinstance(fitted.last_stage, T.ForestPayload) and fitted.last_stage.getNumTrees == 3


def test_weights_of_cells_are_those_of_their_rows():
    """A tree on cells with counts equals the tree on the rows themselves."""
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 4, (500, 2)).astype(np.uint8)
    y = (bins.sum(axis=1) + rng.integers(0, 3, 500) > 4).astype(np.int64)
    cells, n = np.unique(np.column_stack((bins, y)), axis=0, return_counts=True)
    for kind in ("gini", "entropy"):
        one = T.grow(bins, y, np.ones(500), 2, 6, kind=kind)
        two = T.grow(cells[:, :2].astype(np.uint8), cells[:, 2].astype(np.int64), n.astype(float), 2, 6, kind=kind)
        assert (one.feature == two.feature).all() and (one.bin == two.bin).all() and np.allclose(one.value, two.value)


@pytest.mark.parametrize("classes", [2, 3])
def test_search_of_trees_agrees_with_the_plain_loop(rows, classes):
    d = rows.withColumn("y", F.col("y") + F.when(F.col("c") > 0.8, classes - 2).otherwise(0))
    args = (d, FEATS, "y", "classification", "Decision Tree", ["id"])
    grid = {"impurity": {"classification": ["gini", "entropy"]}, "maxDepth": [3, 5]}
    together, one_by_one = (H.search(*args, folds=2, kind="stratified_kfold", grid=grid, batch=b)[0].first() for b in (True, False))
    assert together.best_params == one_by_one.best_params
    assert together.best_score == pytest.approx(one_by_one.best_score, abs=1e-3)


def test_lime_from_sums_equals_one_fit_per_row(rows, monkeypatch):
    train = rows.where("id >= 40")
    fitted = learners("classification")["Logistic Regression"].fit(train, FEATS, "y")
    asked = rows.where("id < 40").withColumn("id", F.when(F.col("id") == 7, 8).when(F.col("id") > 3, F.col("id")))    # keys repeat or are null
    found = X.lime(fitted, asked, ["id"], train, n_samples=30, class_index=1)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(X, "LIME_SUMS", 0)
    plain = X.lime(fitted, asked, ["id"], train, n_samples=30, class_index=1)
    a, b = ({(r.id, r.feature): (r.weight, r.intercept, r.local_pred) for r in d.collect()} for d in (found, plain))
    assert found.columns == plain.columns and a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)


def test_hashed_row_numbers_equal_those_of_one_window(rows, monkeypatch):
    d = rows.withColumn("id", F.when(F.col("id") > 2, F.col("id") - F.col("id") % 2))     # keys repeat or are null
    cols = ["id", "a", "b", "c", "y"]
    for h in (F.md5(F.col("id").cast("string")), F.xxhash64("id")):
        keyed = d.withColumn("h", h)
        want = sorted((r.y, r.n) for r in scan.row_numbers(keyed, ["h", "id", "a", "b", "c"], ["y"], "n").collect())
        monkeypatch.setattr(scan, "SMALL_ROWS", 0)
        found = scan.row_numbers(keyed, ["h", "id", "a", "b", "c"], ["y"], "n", hashed=True)
        got = found.collect()
        assert sorted((r.y, r.n) for r in got) == want
        place = {}
        for r in got:
            place.setdefault(r.y, []).append((r.n, r.h or ("" if isinstance(r.h, str) or r.h is None else r.h)))
        for v in place.values():
            order = [x for _, x in sorted(v, key=lambda t: t[0])]
            assert order == sorted(order)
        monkeypatch.undo()
    whole = S.stratified_split(rows, ["id"], "y", 25, 7).where("is_test")
    want = {r.id for r in whole.collect()}
    monkeypatch.setattr(scan, "SMALL_ROWS", 0)
    assert {r.id for r in S.stratified_split(rows, ["id"], "y", 25, 7).where("is_test").collect()} == want


def test_linear_fits_deal_their_rows_over_the_cores(spark, rows):
    from tabloom.session import spread
    cores = spark.sparkContext.defaultParallelism
    assert spread(rows.repartition(40), 3000).rdd.getNumPartitions() == cores
    assert spread(rows, 9_000_000 * cores).rdd.getNumPartitions() == 3 * cores
    for name in ("Logistic Regression", "Linear SVC"):
        learner = learners("classification")[name]
        assert learner.inner.iterates
        one, two = (learner.fit(d, FEATS, "y").last_stage.coefficients.toArray() for d in (rows, rows.repartition(40)))
        assert one == pytest.approx(two, abs=1e-3)


def test_boosted_trees_of_cells_are_those_of_the_rows(spark):
    import math
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor
    from tabloom.operators.celltrees import BinnedTrees, CellTrees
    from tabloom.operators.models import SparkMLLearner
    from tabloom.operators.shapley import tree_base
    rng = np.random.default_rng(8)
    a, b, e = rng.integers(0, 23, 2000), rng.integers(0, 11, 2000), rng.normal(size=2000)
    made = [(i, float(a[i]), float(b[i]), float(3 * a[i] + 2 * b[i] + 9 * e[i] > 45), float(a[i] + 3 * b[i] + e[i])) for i in range(2000)]
    df = spark.createDataFrame(made, "id int, a double, b double, y double, z double")
    for problem, label, make in (("classification", "y", lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=7)),
                                 ("regression", "z", lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=7))):
        cells = CellTrees("GB", problem, make).fit(df, ["a", "b"], label)
        rows = SparkMLLearner("GB", problem, lambda d, l: make()).fit(df, ["a", "b"], label)
        assert isinstance(cells.last_stage, BinnedTrees)
        one, two = (f.transform(df).orderBy("id").collect() for f in (cells, rows))
        assert one[0].asDict().keys() == two[0].asDict().keys()
        assert [r.prediction for r in one] == pytest.approx([r.prediction for r in two])
        if problem == "classification":
            assert [r.probability[1] for r in one] == pytest.approx([r.probability[1] for r in two])
        assert math.isclose(tree_base(cells, spark), tree_base(rows, spark), rel_tol=1e-9, abs_tol=1e-9)


def test_boosted_trees_of_many_cells_are_fitted_on_the_rows(spark, rows, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from tabloom.operators import celltrees
    monkeypatch.setattr(celltrees, "MAX_CELLS", 1)
    fitted = celltrees.CellTrees("GB", "classification", lambda: GBTClassifier(maxIter=2, maxDepth=2, seed=7)).fit(rows, FEATS, "y")
    assert not isinstance(fitted.last_stage, celltrees.BinnedTrees)


def test_stratified_split_ranks_only_the_last_part_of_a_class(spark, monkeypatch):
    made = [(i % 700 if i % 9 else None, "k", i % 3 if i % 50 else None) for i in range(4000)]     # repeated and null keys, null class
    df = spark.createDataFrame(made, "id int, t string, y int")
    ranked = []
    real = S.row_numbers
    monkeypatch.setattr(S, "row_numbers", lambda d, *a, **k: ranked.append(d.count()) or real(d, *a, **k))
    for key in (["id"], ["id", "t"]):
        for pct in (0, 25, 100):
            got = S.stratified_split(df, key, "y", pct, 7)
            assert got.columns == ["id", "t", "y", "is_test"] and got.count() == 4000
            n = {r.y: (r.n, r.t) for r in got.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
            assert all(t == int(k * pct / 100 + 0.5) for k, t in n.values())
    assert max(ranked) < 1000


def test_folds_and_parts_hold_only_what_is_read(spark, rows):
    from tabloom.plans import leaderboard as L
    learner = learners("classification")["Logistic Regression"]
    assert L.needed(rows, FEATS, "y", [learner]) == [c for c in rows.columns if c in {*FEATS, "y"}]
    assert "id" in L.needed(rows, FEATS, "y", [learners("classification")["KNN"]])
