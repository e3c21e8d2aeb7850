"""Random forests of classification trees on binned rows (M2, K3), and single trees of a search.

Features are binned once at the cut values of Spark ML's trees (at most ``MAX_BINS`` bins, midpoints
between distinct values), and Spark counts the rows of every (bins, class) cell.  A tree sees rows only
through their bins, and the sum of the Poisson(1) weights of n bootstrapped rows is Poisson(n), so a tree
grown on cells with Poisson(n) weights is a tree of the same forest as one grown on the rows.  There are at
most ``MAX_BINS ** features * classes`` cells however many rows there are; up to ``MAX_CELLS`` of them a
tree is one group of a ``groupBy`` and all trees grow at the same time.  Tables of more cells (many
features) are fitted by Spark's own forest, level by level over the rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.quantile import quantile_table

MAX_BINS = 32
MAX_VALUES = 10_000         # distinct values of a feature that are counted one by one
MAX_CELLS = 200_000
HELD = 1_000_000            # cells that a task holds before it hands them on
STATS = 4_000_000           # numbers of the histograms that a tree looks at together
LEAST_GAIN = 1e-12
CACHED = 500_000            # scored cells that a worker's batches share


def feature_values(features: list[str]) -> Column:
    """The features as one array; a missing value is an error, as in Spark's assembler."""
    def one(c):
        v = F.col(c).cast("double")
        return F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"{c} is missing in a row: impute it first")).cast("double")).otherwise(v)
    return F.array(*[one(c) for c in features])


def _matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), p)


# ---------------------------------------------------------------- cut values

def stride_cuts(values: np.ndarray, counts: np.ndarray, max_bins: int = MAX_BINS) -> np.ndarray:
    """Cut values between ascending distinct values, as Spark ML's trees choose them."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= max_bins - 1:
        return middle
    stride = counts.sum() / max_bins
    out, upto, target = [], float(counts[0]), stride
    for i in range(1, len(values)):
        before, upto = upto, upto + float(counts[i])
        if abs(before - target) < abs(upto - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def cut_values(rows: DataFrame, p: int) -> list[np.ndarray]:
    """Per place of ``x``: cuts at exact counts where at most ``MAX_VALUES`` values differ, else at exact quantiles."""
    def count(batches):
        held: list = [(np.empty(0), np.empty(0))] * p
        for batch in batches:
            x = _matrix(batch, p)
            for j in range(p):
                if held[j] is None:
                    continue
                v, n = np.unique(x[:, j], return_counts=True)
                both, at = np.unique(np.concatenate((held[j][0], v)), return_inverse=True)
                held[j] = (both, np.bincount(at, np.concatenate((held[j][1], n)), len(both))) if len(both) <= MAX_VALUES else None
        for j, h in enumerate(held):
            v, n = h if h is not None else (np.array([np.nan]), np.zeros(1))    # nan: too many values
            yield pa.record_batch([pa.array(np.full(len(v), j, np.int32)), pa.array(v), pa.array(n.astype(np.int64))],
                                  names=["j", "v", "n"])

    counts = rows.select("x").mapInArrow(count, "j int, v double, n long").groupBy("j", "v").agg(F.sum("n").alias("n")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        listed = [r["j"] for r in counts.groupBy("j").agg(F.count("*").alias("k"), F.max(F.isnan("v")).alias("many")).collect()
                  if not r["many"] and r["k"] <= MAX_VALUES]
        got = counts.where(F.col("j").isin(listed)).toPandas().sort_values(["j", "v"]) if listed else None
    finally:
        counts.unpersist()
    cuts = {j: stride_cuts(g["v"].to_numpy(float), g["n"].to_numpy(float)) for j, g in got.groupby("j")} if listed else {}
    rest = [j for j in range(p) if j not in cuts]
    if rest:
        long = rows.select(*[F.col("x")[j].alias(f"x{j}") for j in rest])
        q = quantile_table(long, long.columns, [i / MAX_BINS for i in range(1, MAX_BINS)]).first()
        cuts.update({j: np.unique(np.array(q[f"x{j}"] or [], float)) for j in rest})
    return [cuts[j] for j in range(p)]


def bins_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value: a row goes left at cut b where its bin is at most b."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out


# ---------------------------------------------------------------- cells

def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes and the sums of their counts."""
    flat = np.ascontiguousarray(keys).view(np.dtype((np.void, keys.shape[1]))).ravel()
    one, at = np.unique(flat, return_inverse=True)
    return one.view(np.uint8).reshape(len(one), keys.shape[1]), np.bincount(at, n, len(one))


def count_cells(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """b binary (a byte per feature), y and the number of rows n of every cell that has rows."""
    p = len(cuts)

    def run(batches):
        keys, n = np.empty((0, p + 8), np.uint8), np.empty(0)
        for batch in batches:
            if not len(batch):
                continue
            y = np.ascontiguousarray(batch.column("y").to_numpy(zero_copy_only=False), "<f8").view(np.uint8).reshape(len(batch), 8)
            own = np.hstack((bins_of(_matrix(batch, p), cuts), y))
            keys, n = _merged(np.vstack((keys, own)), np.concatenate((n, np.ones(len(own)))))
            if len(keys) > HELD:
                yield out(keys, n)
                keys, n = keys[:0], n[:0]
        yield out(keys, n)

    def out(keys, n):
        y = np.ascontiguousarray(keys[:, p:]).view("<f8").ravel()
        b = pa.array([v.tobytes() for v in np.ascontiguousarray(keys[:, :p])], pa.binary())
        return pa.record_batch([b, pa.array(y), pa.array(n.astype(np.int64))], names=["b", "y", "n"])

    return rows.select("x", "y").mapInArrow(run, "b binary, y double, n long").groupBy("b", "y").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- trees

@dataclass
class Grown:
    """Nodes of one tree; feature -1 marks a leaf. ``value``: weight per class of the rows that reach the node."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins reaches."""
        own = np.arange(len(self.feature))
        inner = self.feature >= 0
        kids = np.column_stack((np.where(inner, self.left, own), np.where(inner, self.right, own))).ravel()
        feature = np.maximum(self.feature, 0).astype(np.int64)
        flat, row = np.ascontiguousarray(bins).ravel(), np.arange(len(bins), dtype=np.int64) * bins.shape[1]
        node = np.zeros(len(bins), np.int64)
        while True:
            after = kids.take(2 * node + (flat.take(row + feature.take(node)) > self.bin.take(node)))
            if (after == node).all():
                return node
            node = after

    def importances(self, p: int) -> np.ndarray:
        """Impurity decrease per feature, shares of 1."""
        out = np.zeros(p)
        used = self.feature >= 0
        np.add.at(out, self.feature[used], (self.gain * self.value.sum(axis=1))[used])
        return out / out.sum() if out.sum() > 0 else out


def impurity(counts: np.ndarray, kind: str) -> np.ndarray:
    """Gini or entropy of class weights on the last axis; 0 where there are none."""
    total = counts.sum(axis=-1)
    share = counts / np.maximum(total, 1e-300)[..., None]
    if kind == "gini":
        return np.where(total > 0, 1.0 - (share * share).sum(axis=-1), 0.0)
    return -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=-1)


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, max_depth: int, subset: int | None = None,
         rng: np.random.Generator | None = None, kind: str = "gini") -> Grown:
    """One tree, level by level, on weighted rows of bins; ``subset`` features are drawn for every node.

    Of equal gains the first feature and bin is taken; a node without a gain is a leaf.  Sibling leaves of the
    same class are merged into their parent, as in Spark's trees.
    """
    p = bins.shape[1]
    have = weight > 0
    bins, y, weight = bins[have], y[have].astype(np.int64), weight[have]
    n_bins = int(bins.max(initial=0)) + 1
    out = {c: [] for c in ("feature", "bin", "left", "right", "value", "gain")}
    node, level, made, depth = np.zeros(len(y), np.int64), 1, 1, 0      # a row's place among the level's nodes
    while level:
        value = np.bincount(node * k + y, weight, level * k).reshape(level, k)
        feature, cut, gain = np.full(level, -1, np.int32), np.zeros(level, np.int32), np.zeros(level)
        open_ = np.flatnonzero((value > 0).sum(axis=1) > 1) if depth < max_depth else np.empty(0, np.int64)
        per = max(1, STATS // (p * n_bins * k))
        order = np.argsort(node, kind="stable")
        begin = np.searchsorted(node[order], np.arange(level + 1))
        for a in range(0, len(open_), per):
            own = open_[a:a + per]
            sizes = begin[own + 1] - begin[own]
            rows = order[np.repeat(begin[own] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
            place = np.repeat(np.arange(len(own)), sizes)
            gains = np.full((len(own), p, n_bins), -np.inf)
            total = value[own]
            n = total.sum(axis=1)
            whole = impurity(total, kind)
            for j in range(p):
                hist = np.bincount((place * n_bins + bins[rows, j]) * k + y[rows], weight[rows], len(own) * n_bins * k)
                left = np.cumsum(hist.reshape(len(own), n_bins, k), axis=1)
                right = total[:, None, :] - left
                nl, nr = left.sum(axis=2), right.sum(axis=2)
                g = whole[:, None] - nl / n[:, None] * impurity(left, kind) - nr / n[:, None] * impurity(right, kind)
                gains[:, j] = np.where((nl > 0) & (nr > 0), g, -np.inf)
            if subset is not None and subset < p:
                drawn = np.argsort(rng.random((len(own), p)), axis=1)[:, :subset]
                shut = np.ones((len(own), p), bool)
                shut[np.arange(len(own))[:, None], drawn] = False
                gains[shut] = -np.inf
            best = gains.reshape(len(own), -1).argmax(axis=1)
            top = gains.reshape(len(own), -1)[np.arange(len(own)), best]
            good = top > LEAST_GAIN
            feature[own[good]], cut[own[good]], gain[own[good]] = best[good] // n_bins, best[good] % n_bins, top[good]
        split = feature >= 0
        left_id = np.where(split, made + 2 * (np.cumsum(split) - 1), -1)
        for c, v in (("feature", feature), ("bin", cut), ("left", left_id), ("right", np.where(split, left_id + 1, -1)),
                     ("value", value), ("gain", gain)):
            out[c].append(v)
        on = split[node]
        bins, y, weight, node = bins[on], y[on], weight[on], node[on]
        went_right = bins[np.arange(len(node)), feature[node]] > cut[node]
        node = left_id[node] - made + went_right
        made, level, depth = made + 2 * int(split.sum()), 2 * int(split.sum()), depth + 1
    ends = np.cumsum([len(v) for v in out["feature"]])
    t = {c: np.concatenate(v) for c, v in out.items()}
    said = t["value"].argmax(axis=1)
    for a, b in zip(ends[-2::-1] - [len(v) for v in out["feature"]][-2::-1], ends[-2::-1]):
        own = a + np.flatnonzero(t["feature"][a:b] >= 0)
        left, right = t["left"][own], t["right"][own]
        same = own[(t["feature"][left] < 0) & (t["feature"][right] < 0) & (said[left] == said[right])]
        t["feature"][same] = t["left"][same] = t["right"][same] = -1
        t["gain"][same] = 0.0
    return Grown(t["feature"].astype(np.int32), t["bin"].astype(np.int32), t["left"].astype(np.int32),
                 t["right"].astype(np.int32), t["value"], t["gain"])


_PARTS = {"feature": np.int32, "bin": np.int32, "left": np.int32, "right": np.int32, "value": np.float64, "gain": np.float64}
TREE = "tree int, " + ", ".join(f"{c} binary" for c in _PARTS)


def _cell_arrays(g: pd.DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, class, count) of the cells in a fixed order."""
    bins = np.frombuffer(b"".join(g["b"]), np.uint8).reshape(len(g), p)
    y, n = g["y"].to_numpy(float).astype(np.int64), g["n"].to_numpy(np.int64)
    order = np.lexsort((y, *bins.T[::-1]))
    return bins[order], y[order], n[order]


def grow_forest(cells: DataFrame, p: int, k: int, n_trees: int, max_depth: int, seed: int) -> list[Grown]:
    """All trees, each one group: Poisson weights of the cells and ceil(sqrt(p)) features a node (one tree: all)."""
    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        bins, y, n = _cell_arrays(g, p)
        rng = np.random.default_rng([seed, tree])
        t = grow(bins, y, rng.poisson(n).astype(float), k, max_depth, math.ceil(math.sqrt(p)) if n_trees > 1 else None, rng)
        return pd.DataFrame([{"tree": tree, **{c: np.ascontiguousarray(getattr(t, c), kind).tobytes() for c, kind in _PARTS.items()}}])

    each = cells.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).repartition(n_trees, "tree")
    out = {}
    for r in each.groupBy("tree").applyInPandas(run, TREE).collect():
        v = {c: np.frombuffer(r[c], kind) for c, kind in _PARTS.items()}
        out[r["tree"]] = Grown(**{**v, "value": v["value"].reshape(-1, k)})
    return [out[i] for i in sorted(out)]


# ---------------------------------------------------------------- learner

class ForestPayload:
    """A fitted forest behind ``transform``: mean class shares of the trees' leaves."""

    def __init__(self, trees: list[Grown], cuts: list[np.ndarray], k: int):
        self.trees, self.cuts, self.k = trees, cuts, k
        total = sum((t.importances(len(cuts)) for t in trees), np.zeros(len(cuts)))
        self.featureImportances = DenseVector(total / total.sum() if total.sum() > 0 else total)

    def to_json(self) -> dict:
        return {"classes": self.k, "cuts": [c.tolist() for c in self.cuts],
                "trees": [{c: base64.b64encode(np.ascontiguousarray(getattr(t, c), kind).tobytes()).decode()
                           for c, kind in _PARTS.items()} for t in self.trees]}

    @staticmethod
    def from_json(d: dict) -> "ForestPayload":
        trees = [Grown(**{c: np.frombuffer(base64.b64decode(t[c]), kind).reshape((-1, d["classes"]) if c == "value" else -1)
                          for c, kind in _PARTS.items()}) for t in d["trees"]]
        return ForestPayload(trees, [np.array(c, float) for c in d["cuts"]], d["classes"])

    def shares(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.k))
        for t in self.trees:
            v = t.value.take(t.leaves(bins), axis=0)
            out += v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
        return out / len(self.trees)

    def transform(self, df: DataFrame, fitted) -> DataFrame:
        model, p = self, len(self.cuts)

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache: dict[bytes, np.ndarray] = {}     # rows of equal bins have equal shares
            for x in batches:
                if not len(x):
                    yield pd.Series([], dtype=object)
                    continue
                bins = np.ascontiguousarray(bins_of(np.stack(x.to_numpy()), model.cuts))
                _, first, at = np.unique(bins.view(np.dtype((np.void, p))).ravel(), return_index=True, return_inverse=True)
                keys = [bins[i].tobytes() for i in first]
                new = [i for i, key in enumerate(keys) if key not in cache]
                if len(cache) + len(new) > CACHED:
                    cache.clear()
                    new = list(range(len(keys)))
                if new:
                    cache.update(zip([keys[i] for i in new], model.shares(bins[first[new]])))
                yield pd.Series(list(np.array([cache[key] for key in keys])[at]))

        out = df.withColumn("_shares", score(feature_values(fitted.features)))
        best = F.array_position("_shares", F.array_max("_shares")) - 1
        return out.withColumn("probability", array_to_vector("_shares")) \
            .withColumn("prediction", best.cast("double")).drop("_shares")


class RandomForest:
    """A random forest for class labels 0..k-1; on cells where they are few, else Spark's on the rows."""

    def __init__(self, name: str = "Random Forest", n_trees: int = 100, max_depth: int = 30, seed: int = 7):
        self.name, self.problem = name, "classification"
        self.n_trees, self.max_depth, self.seed = n_trees, max_depth, seed

    def fit(self, df: DataFrame, features: list[str], label: str):
        from tabloom.operators.models import Fitted, SparkMLLearner
        rows = df.select(feature_values(features).alias("x"), class_code(F.col(label)).alias("y"))
        cuts = cut_values(rows, len(features))
        cells = count_cells(rows, cuts).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            st = cells.agg(F.count("*").alias("n"), F.max("y").alias("top"),
                           F.min((F.col("y") >= 0) & (F.col("y") == F.floor("y"))).alias("codes")).first()
            if 0 < st["n"] <= MAX_CELLS and st["codes"] and st["top"] >= 1:
                k = int(st["top"]) + 1
                trees = grow_forest(cells, len(features), k, self.n_trees, self.max_depth, self.seed)
                return Fitted(self.name, features, label, self.problem, ForestPayload(trees, cuts, k))
        finally:
            cells.unpersist()
        return SparkMLLearner(self.name, self.problem, lambda d, l: RandomForestClassifier(
            numTrees=self.n_trees, maxDepth=self.max_depth, seed=self.seed)).fit(df, features, label)


def class_code(label: Column) -> Column:
    """The label as a number; a missing one is an error, as in Spark's classifiers."""
    y = label.cast("double")
    return F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit("Labels MUST NOT be Null or NaN")).cast("double")).otherwise(y)


# ---------------------------------------------------------------- a search over single trees

def weighted_auc(score: np.ndarray, positive: np.ndarray, n: np.ndarray) -> float:
    """Area under the ROC curve of weighted rows; ties count one half."""
    _, at = np.unique(score, return_inverse=True)
    pos, neg = np.bincount(at, n * positive), np.bincount(at, n * ~positive)
    total = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / total) if total else float("nan")


def weighted_f1(y: np.ndarray, pred: np.ndarray, n: np.ndarray, k: int) -> float:
    """F1 of the classes, weighted by their rows."""
    table = np.bincount(y * k + pred, n, k * k).reshape(k, k)
    hit, own, said = table.diagonal(), table.sum(axis=1), table.sum(axis=0)
    f1 = 2 * hit / np.maximum(own + said, 1e-300)
    return float((f1 * own).sum() / own.sum()) if own.sum() else float("nan")


def tree_scores(folded: DataFrame, features: list[str], cands: list[dict], folds: int, k: int, metric: str) -> dict | None:
    """Score of every (candidate, fold) of single trees, each grown and scored on the cells of its fold in one group.

    ``folded``: the rows with ``_label`` 0..k-1 and ``fold``.  Ranks rows by the leaf's rows of class 1, as the
    evaluator does with a tree's raw prediction.  None where the cells are too many.
    """
    p = len(features)
    rows = folded.select(feature_values(features).alias("x"), class_code(F.col("_label")).alias("y"), "fold")
    parts = []
    try:
        for f in range(folds):
            cuts = cut_values(rows.where(F.col("fold") != f), p)
            # class and part in one number: odd ones are held out
            coded = rows.select("x", (2 * F.col("y") + (F.col("fold") == f).cast("double")).alias("y"))
            parts.append(count_cells(coded, cuts).persist(StorageLevel.MEMORY_AND_DISK))
            if parts[-1].count() > 2 * MAX_CELLS:
                return None
        cells = reduce(DataFrame.unionByName, [c.withColumn("f", F.lit(f)) for f, c in enumerate(parts)])

        def run(key, g: pd.DataFrame) -> pd.DataFrame:
            f, c = int(key[0]), int(key[1])
            bins, code, n = _cell_arrays(g, p)
            y, held = code // 2, code % 2 == 1
            t = grow(bins[~held], y[~held], n[~held].astype(float), k, cands[c].get("maxDepth", 5), kind=cands[c].get("impurity", "gini"))
            v = t.value.take(t.leaves(bins[held]), axis=0)
            got = weighted_auc(v[:, 1], y[held] == 1, n[held]) if metric == "roc_auc" else \
                weighted_f1(y[held], v.argmax(axis=1), n[held], k)
            return pd.DataFrame({"candidate": [c], "fold": [f], "v": [got]})

        each = cells.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(cands) - 1))))
        got = each.repartition(len(cands) * folds, "f", "c").groupBy("f", "c") \
            .applyInPandas(run, "candidate int, fold int, v double").collect()
        return {(r["candidate"], r["fold"]): r["v"] for r in got}
    finally:
        for c in parts:
            c.unpersist()
