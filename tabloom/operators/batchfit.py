"""Fits of many (candidate, fold) models at once, for the hyperparameter search (H1).

Logistic regression (two classes or softmax): every iteration is one job over the folded
table.  Each task adds up loss, gradient and Hessian of all open models as matrix products
over its rows, with fold membership as a mask; Spark adds the tasks' numbers per place, and
the driver takes one proximal Newton step per model (coordinate descent where an L1 term
stands, a linear solve elsewhere) with a backtracking line search.  Models that have
converged leave the next job.

Linear regression: one job gives count, means and the centred cross-products of every
part of every fold; candidates are solved and scored from those p x p tables alone.

kNN: one neighbour list per (fold, distinct metric) at the largest k serves every k and
weighting.

The objective of a candidate is Spark ML's own without standardisation: mean loss +
regParam * (elasticNetParam * |w|_1 + (1 - elasticNetParam) / 2 * |w|^2), intercepts free.
Only numbers in proportion to models x features^2 reach the driver (``MAX_STATS``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scan import prefix_sums

# numbers of one iteration that reach the driver: models are fitted in several groups beyond
MAX_STATS = 4_000_000
MAX_ITER = 100
TOL = 1e-10
# cells of a task's temporary matrices
CELLS = 4_000_000
# those of an iteration's: they stay in a core's cache
BLOCK = 65_536


def feature_vector(df: DataFrame, features: list[str]):
    """One array<double> column of the features (an array feature alone is taken as it is)."""
    if len(features) == 1 and df.schema[features[0]].dataType.simpleString().startswith("array"):
        return F.col(features[0]).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _triangle(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


# ---------------------------------------------------------------- logistic and softmax

def _statistics(rows: DataFrame, w: np.ndarray, fold: np.ndarray, n_classes: int) -> list[tuple]:
    """(rows, loss, gradient, Hessian) of each model over the rows outside its fold."""
    m, k, p1 = w.shape
    tri = _triangle(k * p1)
    width = 2 + k * p1 + len(tri[0])

    def run(batches):
        total = np.zeros((m, width))
        for batch in batches:
            x_all, y_all = _matrix(batch.column("x")), batch.column("y").to_numpy()
            f_all = batch.column("fold").to_numpy()
            step = max(64, BLOCK // max(m * k, p1 * p1))
            for a in range(0, len(y_all), step):
                x = np.column_stack((x_all[a:a + step], np.ones(len(y_all[a:a + step]))))
                _add(total, x, y_all[a:a + step].astype(np.int64), f_all[a:a + step])
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    def _add(total, x, y, f):
        member = (f[:, None] != fold[None, :]).astype(float)              # rows x models
        pairs = _triangle(p1)
        outer = x[:, pairs[0]] * x[:, pairs[1]]
        if n_classes == 2:
            z = x @ w[:, 0].T
            above, t = z >= 0, y[:, None]
            # one exponential of -|z| gives loss, probability and their slopes
            e = np.abs(z)
            np.exp(np.negative(e, out=e), out=e)
            q = 1.0 / (1.0 + e)
            loss = np.log1p(e)
            loss += np.where(above, z, 0.0)
            z *= t
            loss -= z
            total[:, 0] += member.sum(0)
            total[:, 1] += np.einsum("nm,nm->m", member, loss)
            e *= q                                                        # the smaller of the two probabilities
            off = np.where(above, q, e)
            off -= t
            off *= member
            total[:, 2:2 + p1] += off.T @ x
            e *= q
            e *= member
            total[:, 2 + p1:] += e.T @ outer
            return
        z = np.einsum("np,mkp->nmk", x, w, optimize=True)
        top = z.max(axis=2, keepdims=True)
        e = np.exp(z - top)
        norm = e.sum(axis=2, keepdims=True)
        prob = e / norm
        hit = y[:, None, None] == np.arange(k)
        loss = top[:, :, 0] + np.log(norm[:, :, 0]) - np.where(hit, z, 0.0).sum(2)
        total[:, 0] += member.sum(0)
        total[:, 1] += (member * loss).sum(0)
        total[:, 2:2 + k * p1] += np.einsum("nmk,np->mkp", (prob - hit) * member[:, :, None], x,
                                            optimize=True).reshape(m, -1)
        h = np.zeros((m, k, p1, k, p1))
        for a in range(k):
            for b in range(a, k):
                c = prob[:, :, a] * ((a == b) - prob[:, :, b]) * member
                s = np.zeros((m, p1, p1))
                s[:, pairs[0], pairs[1]] = c.T @ outer
                s[:, pairs[1], pairs[0]] = s[:, pairs[0], pairs[1]]
                h[:, a, :, b, :] = s
                h[:, b, :, a, :] = s
        total[:, 2 + k * p1:] += h.reshape(m, k * p1, k * p1)[:, tri[0], tri[1]]

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(m * width)
    flat[got["i"].to_numpy()] = got["v"].to_numpy()
    out = []
    for s in flat.reshape(m, width):
        h = np.zeros((k * p1, k * p1))
        h[tri] = s[2 + k * p1:]
        h = h + np.triu(h, 1).T
        n = max(s[0], 1.0)
        out.append((s[0], s[1] / n, s[2:2 + k * p1] / n, h / n))
    return out


def _newton_direction(g: np.ndarray, h: np.ndarray, w: np.ndarray, l1: float, free: np.ndarray) -> np.ndarray:
    """Minimiser of g.d + d.H.d / 2 + l1 * |w + d|_1 over the penalised places."""
    if l1 == 0:
        return -np.linalg.lstsq(h, g, rcond=1e-12)[0]
    d, hd = np.zeros_like(w), np.zeros_like(w)
    diag = np.maximum(np.diag(h), 1e-12)
    for _ in range(500):
        largest = 0.0
        for j in range(len(w)):
            target = w[j] + d[j] - (g[j] + hd[j]) / diag[j]
            new = target if free[j] else np.sign(target) * max(abs(target) - l1 / diag[j], 0.0)
            move = new - w[j] - d[j]
            if move:
                d[j] += move
                hd += h[:, j] * move
                largest = max(largest, abs(move) * np.sqrt(diag[j]))
        if largest < 1e-12:
            break
    return d


def fit_logistic(rows: DataFrame, penalties: list[tuple[float, float]], folds: list[int], p: int, n_classes: int,
                 max_iter: int = MAX_ITER, tol: float = TOL) -> np.ndarray:
    """Weights (models x outputs x features + 1, the intercept last) of all models.

    ``rows``: x array<double>, y (0..k-1), fold; materialised, read once per iteration.
    Model i has penalties (C-free regParam per mean loss, elasticNetParam) ``penalties[i]`` and
    is fitted on the rows outside fold ``folds[i]``.  A regParam given as a function of the
    number of training rows is called with it.
    """
    outputs = 1 if n_classes == 2 else n_classes
    size = outputs * (p + 1)
    per = max(1, MAX_STATS // (2 + size + size * (size + 1) // 2))
    if len(folds) > per:
        return np.concatenate([fit_logistic(rows, penalties[a:a + per], folds[a:a + per], p, n_classes, max_iter, tol)
                               for a in range(0, len(folds), per)])
    m = len(folds)
    w = np.zeros((m, size))
    trial, step, ahead = w.copy(), np.ones(m), np.zeros(m)
    value = np.full(m, np.inf)
    direction = np.zeros((m, size))
    free = np.tile(np.append(np.zeros(p, bool), True), outputs)
    open_ = np.arange(m)
    for _ in range(max_iter):
        stats = _statistics(rows, trial[open_].reshape(len(open_), outputs, p + 1),
                                 np.array(folds)[open_], n_classes)
        still = []
        for i, (n, loss, g, h) in zip(open_.tolist(), stats):
            if n == 0:
                continue
            reg, mix = penalties[i]
            reg = reg(n) if callable(reg) else reg
            l1, l2 = reg * mix, reg * (1 - mix)
            t = trial[i]
            pen = np.where(free, 0.0, t)
            f = loss + l1 * np.abs(pen).sum() + l2 / 2 * (pen @ pen)
            if f > value[i] + 1e-4 * step[i] * ahead[i] + 1e-14 * abs(f) and step[i] > 1e-8:
                # not low enough: half the step from the last point
                step[i] /= 2
                trial[i] = w[i] + step[i] * direction[i]
                still.append(i)
                continue
            w[i], value[i] = t, f
            g = g + l2 * pen
            h = h + np.diag(np.where(free, 0.0, l2))
            d = _newton_direction(g, h, t, l1, free)
            ahead[i] = g @ d + l1 * (np.abs(np.where(free, 0.0, t + d)).sum() - np.abs(pen).sum())
            if -ahead[i] <= tol * max(1.0, abs(f)):
                continue
            direction[i], step[i] = d, 1.0
            trial[i] = t + d
            still.append(i)
        open_ = np.array(still, dtype=np.int64)
        if not len(open_):
            break
    return w.reshape(m, outputs, p + 1)


def score_logistic(rows: DataFrame, weights: np.ndarray, folds: list[int], candidate: list[int], n_classes: int) -> DataFrame:
    """candidate, fold, y, pred, score of every held-out row and candidate (score: probability of class 1)."""
    fold_of, cand = np.array(folds), np.array(candidate, np.int32)

    def run(batches):
        for batch in batches:
            x_all, y_all, f_all = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            step = max(1, CELLS // (weights.shape[0] * weights.shape[1]))
            for a in range(0, len(y_all), step):
                x = np.column_stack((x_all[a:a + step], np.ones(len(y_all[a:a + step]))))
                y, f = y_all[a:a + step], f_all[a:a + step]
                for fold in np.unique(f).tolist():
                    own, here = np.flatnonzero(fold_of == fold), np.flatnonzero(f == fold)
                    z = np.einsum("np,mkp->nmk", x[here], weights[own], optimize=True)
                    if n_classes == 2:
                        score = 1.0 / (1.0 + np.exp(-z[:, :, 0]))
                        pred = (score > 0.5).astype(float)
                    else:
                        score, pred = np.zeros(z.shape[:2]), z.argmax(2).astype(float)
                    k = len(own)
                    yield pa.record_batch([
                        pa.array(np.tile(cand[own], len(here))), pa.array(np.full(len(here) * k, fold, np.int32)),
                        pa.array(np.repeat(y[here], k)), pa.array(pred.ravel()), pa.array(score.ravel())],
                        names=["candidate", "fold", "y", "pred", "score"])

    return rows.mapInArrow(run, SCORES)


SCORES = "candidate int, fold int, y double, pred double, score double"


# ---------------------------------------------------------------- metrics of all candidates

def auc_by_candidate(scored: DataFrame) -> dict[tuple[int, int], float]:
    """Exact ROC AUC (ties one half) of every (candidate, fold), in one pass of distributed running sums."""
    counts = scored.groupBy("candidate", "fold", "score").agg(
        F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") != 1).cast("long")).alias("neg"))
    below = prefix_sums(counts, ["score"], {"below": "neg"}, ["candidate", "fold"], inclusive=False)
    got = below.groupBy("candidate", "fold").agg(
        F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return {(r["candidate"], r["fold"]): r["s"] / (r["p"] * r["n"]) if r["p"] and r["n"] else float("nan")
            for r in got.collect()}


def f1_by_candidate(scored: DataFrame) -> dict[tuple[int, int], float]:
    """Weighted F1 over all labels of every (candidate, fold), from confusion counts."""
    from tabloom.operators.evaluate import _weighted
    held: dict[tuple[int, int], dict] = {}
    for r in scored.groupBy("candidate", "fold", "y", "pred").count().collect():
        held.setdefault((r["candidate"], r["fold"]), {})[r["y"], r["pred"]] = r["count"]
    return {key: _weighted(c, sorted({x for k in c for x in k if x is not None}))[2] for key, c in held.items()}


def error_by_candidate(scored: DataFrame, metric: str) -> dict[tuple[int, int], float]:
    """RMSE or MAE of every (candidate, fold)."""
    e = F.col("y") - F.col("pred")
    value = F.avg(F.abs(e)) if metric == "mae" else F.sqrt(F.avg(e * e))
    return {(r["candidate"], r["fold"]): r["v"] for r in scored.groupBy("candidate", "fold").agg(value.alias("v")).collect()}


def means(by_fold: dict[tuple[int, int], float], n_candidates: int) -> list[float]:
    """Mean over the folds that have a value, per candidate."""
    out = []
    for c in range(n_candidates):
        vals = [v for (k, _), v in sorted(by_fold.items()) if k == c and v is not None and v == v]
        out.append(sum(vals) / len(vals) if vals else float("nan"))
    return out


# ---------------------------------------------------------------- linear regression

def fold_moments(rows: DataFrame, p: int) -> dict:
    """part -> (n, mean of (x, y), centred cross-products of (x, y)); rows carry a ``part`` number.

    Each task centres on its own first batch; tasks are merged by the pairwise update.
    """
    q = p + 1

    def run(batches):
        held = {}
        for batch in batches:
            v = np.column_stack((_matrix(batch.column("x")), batch.column("y").to_numpy()))
            part = batch.column("part").to_numpy()
            for k in np.unique(part).tolist():
                own = v[part == k]
                mean = own.mean(0)
                c = own - mean
                held[k] = merge(held.get(k), (len(own), mean, c.T @ c))
        for k, (n, mean, s) in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([float(n)]), pa.array([mean.tolist()], pa.list_(pa.float64())),
                                   pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "n", "mean", "s"])

    def merge(a, b):
        if a is None:
            return b
        n = a[0] + b[0]
        d = b[1] - a[1]
        return n, a[1] + d * b[0] / n, a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    def fold_in(key, frame):
        import pandas as pd
        out = None
        for n, mean, s in zip(frame["n"], frame["mean"], frame["s"]):
            out = merge(out, (n, np.array(mean), np.array(s).reshape(q, q)))
        return pd.DataFrame({"part": [key[0]], "n": [out[0]], "mean": [out[1].tolist()], "s": [out[2].ravel().tolist()]})

    schema = "part int, n double, mean array<double>, s array<double>"
    # one row per task and part: a part's group has one row per task
    merged = rows.mapInArrow(run, schema).groupBy("part").applyInPandas(fold_in, schema)
    return {r["part"]: (r["n"], np.array(r["mean"]), np.array(r["s"]).reshape(q, q)) for r in merged.collect()}


def merge_moments(items: list) -> tuple:
    out = None
    for b in items:
        if out is None:
            out = b
            continue
        n, d = out[0] + b[0], b[1] - out[1]
        out = (n, out[1] + d * b[0] / n, out[2] + b[2] + np.outer(d, d) * (out[0] * b[0] / n))
    return out


def fit_linear(moments: tuple, reg: float, mix: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from (n, means, cross-products), Spark ML's objective.

    Spark divides the label by its sample deviation and regParam with it, so the L2 term
    is regParam * (1 - mix) / deviation in the label's own unit; the L1 term is unchanged.
    """
    n, mean, s = moments
    p = len(mean) - 1
    h, g = s[:p, :p] / n, s[:p, p] / n
    dev = np.sqrt(s[p, p] / max(n - 1, 1))
    l1, l2 = reg * mix, reg * (1 - mix) / dev if dev > 0 else 0.0
    w = np.zeros(p)
    if dev > 0:
        a = h + l2 * np.eye(p)
        w = _newton_direction(-g, a, w, l1, np.zeros(p, bool))
    return w, float(mean[p] - w @ mean[:p])


def linear_errors(moments: tuple, w: np.ndarray, intercept: float) -> float:
    """RMSE on the rows behind ``moments``."""
    n, mean, s = moments
    v = np.append(-w, 1.0)
    bias = mean @ v - intercept
    return float(np.sqrt(max(v @ s @ v / n, 0.0) + bias * bias))


# ---------------------------------------------------------------- nearest neighbours

def score_neighbours(lists: DataFrame, candidates: list[tuple[int, str]], n_classes: int) -> DataFrame:
    """candidate, fold, y, pred, score from neighbour lists, for several (k, weighting) of one metric.

    ``lists``: y, fold, near array<struct<dist, lab>> in rank order, at the largest k.  Ties between
    classes go to the smaller label; a neighbour at distance 0 outweighs all others by distance.
    ``n_classes`` 0 means regression.
    """
    most = max(k for k, _ in candidates)

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            near = batch.column("near")
            offs = near.offsets.to_numpy()
            size = np.diff(offs)
            row, place = np.repeat(np.arange(n), size), np.arange(offs[-1] - offs[0]) - np.repeat(offs[:-1] - offs[0], size)
            flat = near.flatten()
            dist, lab = np.full((n, most), np.nan), np.zeros((n, most))
            dist[row, place] = flat.field("dist").to_numpy(zero_copy_only=False)
            lab[row, place] = flat.field("lab").to_numpy(zero_copy_only=False)
            have = ~np.isnan(dist)
            with np.errstate(divide="ignore"):
                close = np.where(have, np.where(dist == 0, 1e300, 1.0 / dist), 0.0)
            for c, (k, weights) in enumerate(candidates):
                w = (close if weights == "distance" else have.astype(float))[:, :k]
                if n_classes:
                    votes = np.stack([(w * (lab[:, :k] == j)).sum(1) for j in range(n_classes)], axis=1)
                    pred = votes.argmax(1).astype(float)
                    total = votes.sum(1)
                    score = np.divide(votes[:, min(1, n_classes - 1)], total, out=np.zeros(n), where=total > 0)
                else:
                    total = w.sum(1)
                    # weights of 1e300 times a label may overflow: scale by the largest first
                    unit = w / np.maximum(w.max(1), 1e-300)[:, None]
                    pred = np.divide((unit * lab[:, :k]).sum(1), unit.sum(1), out=np.full(n, np.nan), where=total > 0)
                    score = pred
                yield pa.record_batch([pa.array(np.full(n, c, np.int32)), batch.column("fold"), batch.column("y"),
                                       pa.array(pred), pa.array(score)], names=["candidate", "fold", "y", "pred", "score"])

    return lists.mapInArrow(run, SCORES)


def neighbour_lists(near: DataFrame, queries: DataFrame, qkey: str, train: DataFrame, rkey: str, fold: int) -> DataFrame:
    """y, fold and the ranked (dist, lab) list of every query row; at most k entries each."""
    lab = train.select(F.col(rkey).alias("rkey"), F.col("_label").alias("lab"))
    ranked = near.join(lab, "rkey").groupBy("qkey").agg(
        F.sort_array(F.collect_list(F.struct("rank", "dist", "lab"))).alias("near"))
    return queries.select(F.col(qkey).alias("qkey"), F.col("_label").alias("y")).join(ranked, "qkey").select(
        "y", F.lit(fold).alias("fold"), F.transform("near", lambda s: F.struct(s["dist"].alias("dist"), s["lab"].alias("lab"))).alias("near"))

