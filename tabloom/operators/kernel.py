"""Kernel support vector machines (M10 and the kernel rows of the searches): RBF kernel by random Fourier features.

The kernel exp(-gamma |x - y|^2) is the mean over ``n_features`` seeded directions of
2 cos(w x + b) cos(w y + b), w normal with variance 2 gamma; so a kernel machine is a linear one on
phi(x) = sqrt(2 / n_features) cos(w x + b), and its error in a kernel value falls with
1 / sqrt(n_features).  Rows are mapped inside the task that uses them; phi is never stored.

The loss is hinge (classes, one against the rest beyond two) or epsilon-insensitive (numbers), rounded
off by a parabola of width ``ROUND`` where it bends, plus |w|^2 / (2 C n), the intercept free.  L-BFGS
runs on the driver for all models of a search at once (every C, gamma, class and fold); one job per
iteration adds up all their losses and gradients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.vectorsum import block_sum
from tabloom.operators.batchfit import SCORES, _matrix, feature_vector
from tabloom.session import checkpoint_dir, spread

N_FEATURES = 256
ROUND = 0.05
MEMORY = 8
# cells of a block's features and values: they stay in a core's cache
BLOCK = 125_000


def directions(p: int, n_features: int = N_FEATURES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unit directions (p x n_features, scaled by sqrt(2 gamma) on use) and phases."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(p, n_features)), rng.uniform(0, 2 * math.pi, n_features)


def _wave() -> np.ndarray:
    """Coefficients c with sin(2 pi s) = s (c[0] + c[1] s^2 + ...), right to 1e-8 for |s| <= 1/4."""
    at = (np.cos((np.arange(200) + 0.5) * math.pi / 200) + 1) / 32
    s = np.sqrt(at)
    fit = np.polynomial.Chebyshev.fit(at, np.sin(2 * math.pi * s) / s, 4, domain=[0, 1 / 16])
    return fit.convert(kind=np.polynomial.Polynomial).coef


WAVE = _wave()
# turns up to which an angle is taken in single precision
NEAR = 4.0


class Waves:
    """phi(x) of blocks of rows, in buffers that stay in a core's cache: a result stands until the next call.

    Angles are counted in turns and reduced to one turn, in double precision for rows far from the origin; the
    cosine of what is left is a polynomial in single precision, right to about 1e-6, far inside the error of the
    features themselves.  Products with phi are taken in double precision.
    """

    def __init__(self, gamma: float, w: np.ndarray, b: np.ndarray, rows: int, p: int):
        self.w, self.b, self.rows = w * (math.sqrt(2 * gamma) / (2 * math.pi)), b / (2 * math.pi), rows
        self.single = np.vstack((self.w, self.b)).astype(np.float32)
        self.widest = np.abs(self.w).max(axis=1)
        self.c = (WAVE * math.sqrt(2 / len(b))).astype(np.float32)
        self.s, self.u, self.v = (np.empty((rows, len(b)), np.float32) for _ in range(3))
        self.x = np.ones((rows, p + 1), np.float32)
        self.phi = np.ones((rows, len(b) + 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        s, u, v = self.s[:n], self.u[:n], self.v[:n]
        reach = np.abs(x) @ self.widest
        far = np.flatnonzero(~(reach <= NEAR))
        near = x if not len(far) else np.where((reach <= NEAR)[:, None], x, 0.0)
        self.x[:n, :-1] = near
        np.matmul(self.x[:n], self.single, out=s)
        np.rint(s, out=u)
        s -= u
        if len(far):
            z = x[far] @ self.w + self.b
            s[far] = z - np.rint(z)
        # cos(2 pi t) = sin(2 pi (1/4 - |t|))
        np.abs(s, out=s)
        np.subtract(np.float32(0.25), s, out=s)
        np.multiply(s, s, out=u)
        np.multiply(u, self.c[4], out=v)
        for k in (3, 2, 1):
            v += self.c[k]
            v *= u
        v += self.c[0]
        np.multiply(v, s, out=v)
        self.phi[:n, :-1] = v
        return self.phi[:n]

    def products(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """phi(x) times each row of ``weights``."""
        out = np.empty((len(x), len(weights)))
        for a in range(0, len(x), self.rows):
            out[a:a + self.rows] = self(x[a:a + self.rows]) @ weights.T
        return out


def block_rows(n_features: int, machines: int = 1) -> int:
    """Rows of a block: its cells stay in a core's cache."""
    return max(64, BLOCK // (n_features + 1 + machines))


def fourier(x: np.ndarray, gamma: float, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """phi(x) with a last column of ones."""
    step = block_rows(len(b))
    waves = Waves(gamma, w, b, min(step, max(1, len(x))), x.shape[1])
    out = np.empty((len(x), len(b) + 1))
    for a in range(0, len(x), waves.rows):
        out[a:a + waves.rows] = waves(x[a:a + waves.rows])
    return out


def rounded(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """max(t, 0) with a parabola of width ROUND at the bend, and its slope."""
    low = np.clip(t, 0, ROUND)
    return np.where(t >= ROUND, t - ROUND / 2, low * low / (2 * ROUND)), low / ROUND


@dataclass(frozen=True)
class Machine:
    """One model: penalty, kernel width, the fold it leaves out (-1: none) and the class that is +1 (None: numbers)."""
    c: float
    gamma: float
    fold: int = -1
    positive: int | None = None


# Rows are held as blocks of them: each column is the bytes of one array, so a pass reads no row by itself.
ROWS = "x binary, y binary, fold binary"


def row_blocks(rows: DataFrame):
    """``rows`` (x array<double>, y, fold) as an RDD of blocks, held and checkpointed with the first job that reads it."""
    def run(batches):
        for batch in batches:
            if len(batch):
                parts = ((_matrix(batch.column("x")), np.float64), (batch.column("y").to_numpy(), np.float64),
                         (batch.column("fold").to_numpy(), np.int32))
                yield pa.record_batch([pa.array([np.ascontiguousarray(v, kind).tobytes()], pa.binary()) for v, kind in parts],
                                      names=["x", "y", "fold"])

    checkpoint_dir(rows.sparkSession)
    blocks = rows.mapInArrow(run, ROWS).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    return blocks


def _losses(z: np.ndarray, y: np.ndarray, positive: list[int | None], epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Losses and their slopes in z (rows x machines)."""
    if positive[0] is None:
        r = z - y[:, None]
        v, s = rounded(np.abs(r) - epsilon)
        return v, s * np.sign(r)
    t = np.where(y[:, None] == np.array(positive), 1.0, -1.0)
    v, s = rounded(1 - t * z)
    return v, -t * s


def _loss(z: np.ndarray, y: np.ndarray, positive: int | None, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss of one machine and its slope in z."""
    v, s = _losses(z[:, None], y, [positive], epsilon)
    return v[:, 0], s[:, 0]


def fit_machines(rows: DataFrame, machines: list[Machine], p: int, epsilon: float = 0.1, n_features: int = N_FEATURES,
                 seed: int = 0, max_iter: int = 100, tol: float = 1e-5) -> np.ndarray:
    """Weights (machines x n_features + 1) by L-BFGS.  ``rows``: x array<double>, y, fold; read once."""
    w0, b0 = directions(p, n_features, seed)
    blocks = row_blocks(rows)
    try:
        return _descend(blocks, machines, p, epsilon, w0, b0, max_iter, tol)
    finally:
        blocks.unpersist()


def _descend(held, machines: list[Machine], p: int, epsilon: float, w0: np.ndarray, b0: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    n_features = len(b0)
    m, d = len(machines), n_features + 1

    def evaluate(weights: np.ndarray, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        width = d + 2
        step = block_rows(n_features, len(which))
        groups = []
        for gamma, number in sorted({(machines[i].gamma, machines[i].positive is None) for i in which}):
            here = [k for k, i in enumerate(which) if (machines[i].gamma, machines[i].positive is None) == (gamma, number)]
            groups.append((gamma, here, np.array([machines[which[k]].fold for k in here]), [machines[which[k]].positive for k in here],
                           np.ascontiguousarray(weights[[which[k] for k in here]].T)))

        def add(blocks):
            out = np.zeros((len(which), width))
            waves = [Waves(gamma, w0, b0, step, p) for gamma, *_ in groups]
            for x_all, y_all, f_all in blocks:
                y_all, f_all = np.frombuffer(y_all, np.float64), np.frombuffer(f_all, np.int32)
                x_all = np.frombuffer(x_all, np.float64).reshape(len(y_all), p)
                for a in range(0, len(y_all), step):
                    x, y, f = x_all[a:a + step], y_all[a:a + step], f_all[a:a + step]
                    for wave, (_, here, folds, positive, own) in zip(waves, groups):
                        phi = wave(x)
                        member = f[:, None] != folds
                        v, s = _losses(phi @ own, y, positive, epsilon)
                        out[here, 0] += member.sum(axis=0)
                        out[here, 1] += (v * member).sum(axis=0)
                        out[here, 2:] += (s * member).T @ phi
            return out.ravel()

        s = block_sum(held, add, len(which) * width).reshape(len(which), width)
        value, slope = np.zeros(len(which)), np.zeros((len(which), d))
        for k, i in enumerate(which):
            n = max(s[k, 0], 1.0)
            flat = np.append(weights[i, :-1], 0.0)
            reg = 1.0 / (machines[i].c * n)
            value[k] = s[k, 1] / n + reg / 2 * flat @ flat
            slope[k] = s[k, 2:] / n + reg * flat
        return value, slope

    w = np.zeros((m, d))
    value, slope = evaluate(w, list(range(m)))
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(m)]
    way = -slope.copy()
    step = np.array([min(1.0, 1.0 / max(np.linalg.norm(g), 1e-12)) for g in slope])
    open_ = [i for i in range(m) if np.linalg.norm(slope[i]) > tol]
    for _ in range(max_iter):
        if not open_:
            break
        trial = w.copy()
        for i in open_:
            trial[i] = w[i] + step[i] * way[i]
        v, g = evaluate(trial, open_)
        still = []
        for k, i in enumerate(open_):
            if v[k] > value[i] + 1e-4 * step[i] * (slope[i] @ way[i]):
                step[i] /= 2
                if step[i] > 1e-10:
                    still.append(i)
                continue
            s, y = trial[i] - w[i], g[k] - slope[i]
            if s @ y > 1e-12 * (y @ y):
                past[i] = [*past[i], (s, y)][-MEMORY:]
            fell = value[i] - v[k]
            w[i], value[i], slope[i] = trial[i], v[k], g[k]
            if np.linalg.norm(slope[i]) <= tol or fell <= 1e-9 * max(1.0, abs(v[k])):
                continue
            way[i], step[i] = -_two_loops(slope[i], past[i]), 1.0
            if slope[i] @ way[i] >= 0:
                past[i], way[i] = [], -slope[i]
            still.append(i)
        open_ = still
    return w


def _two_loops(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The L-BFGS product of the inverse Hessian with g."""
    q, kept = g.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(kept)):
        q += s * (a - (y @ q) / (s @ y))
    return q


def score_machines(rows: DataFrame, machines: list[Machine], weights: np.ndarray, candidate: list[int], p: int,
                   n_features: int = N_FEATURES, seed: int = 0) -> DataFrame:
    """candidate, fold, y, pred, score of every held-out row; the machines of a candidate and fold are its classes."""
    w0, b0 = directions(p, n_features, seed)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, one in enumerate(machines):
        groups.setdefault((candidate[i], one.fold), []).append(i)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y, f = _matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for gamma in sorted({one.gamma for one in machines}):
                wave = Waves(gamma, w0, b0, block_rows(n_features), p)
                for fold in np.unique(f).tolist():
                    here = np.flatnonzero(f == fold)
                    own = [i for i, one in enumerate(machines) if one.gamma == gamma and one.fold == fold]
                    if not own:
                        continue
                    z = dict(zip(own, wave.products(x[here], weights[own]).T))
                    for (c, of), parts in groups.items():
                        if of != fold or machines[parts[0]].gamma != gamma:
                            continue
                        pred, score = decide(np.column_stack([z[i] for i in parts]), [machines[i].positive for i in parts])
                        yield pa.record_batch([pa.array(np.full(len(here), c, np.int32)), pa.array(np.full(len(here), fold, np.int32)),
                                               pa.array(y[here]), pa.array(pred), pa.array(score)],
                                              names=["candidate", "fold", "y", "pred", "score"])

    return rows.mapInArrow(run, SCORES)


def decide(z: np.ndarray, positive: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and scores from the machines' values."""
    if positive[0] is None:
        return z[:, 0], z[:, 0]
    if len(positive) == 1:
        return (z[:, 0] > 0).astype(float), z[:, 0]
    return np.array(positive, float)[z.argmax(axis=1)], z.max(axis=1)


def scale_gamma(df: DataFrame, features: list[str]) -> float:
    """The default width: 1 / (features * variance of all feature values together)."""
    parts = df.agg(*[F.avg(f).alias(f"m{j}") for j, f in enumerate(features)],
                   *[F.avg(F.col(f) * F.col(f)).alias(f"q{j}") for j, f in enumerate(features)]).first()
    p = len(features)
    mean = sum(parts[f"m{j}"] or 0.0 for j in range(p)) / p
    var = sum(parts[f"q{j}"] or 0.0 for j in range(p)) / p - mean * mean
    return 1.0 / (p * var) if var > 0 else 1.0


class _KernelPayload:
    def __init__(self, weights, gamma, positive, classes, n_features, seed):
        self.weights, self.gamma, self.positive, self.classes = weights, gamma, positive, classes
        self.n_features, self.seed = n_features, seed

    def transform(self, df: DataFrame, fitted) -> DataFrame:
        weights, gamma, positive = self.weights, self.gamma, self.positive
        w0, b0 = directions(len(fitted.features), self.n_features, self.seed)

        @F.pandas_udf("struct<pred:double,score:double>")
        def value(*cols: pd.Series) -> pd.DataFrame:
            x = np.column_stack([c.to_numpy(float) for c in cols])
            wave = Waves(gamma, w0, b0, block_rows(len(b0)), x.shape[1])
            pred, score = decide(wave.products(x, weights), positive)
            return pd.DataFrame({"pred": pred, "score": score})

        out = df.withColumn("_svm", value(*[F.col(c).cast("double") for c in fitted.features]))
        if positive[0] is None:
            return out.withColumn("prediction", F.col("_svm.pred")).drop("_svm")
        names = F.array(*[F.lit(float(c)) for c in self.classes])
        return out.withColumn("prediction", F.get(names, F.col("_svm.pred").cast("int"))) \
            .withColumn("decision", F.col("_svm.score")).drop("_svm")


class KernelMachine:
    """SVC and SVR with an RBF kernel; ``gamma`` None is 1 / (features * variance)."""

    def __init__(self, problem: str, c: float = 1.0, gamma: float | None = None, epsilon: float = 0.1,
                 n_features: int = N_FEATURES, seed: int = 0):
        self.name, self.problem = ("SVC" if problem == "classification" else "SVR"), problem
        self.c, self.gamma, self.epsilon, self.n_features, self.seed = c, gamma, epsilon, n_features, seed

    def fit(self, df: DataFrame, features: list[str], label: str):
        from tabloom.operators.models import Fitted, class_labels
        classes = class_labels(df, label) if self.problem == "classification" else []
        if self.problem == "classification" and len(classes) < 2:
            raise ValueError("a classifier needs two classes")
        gamma = self.gamma if self.gamma is not None else scale_gamma(df, features)
        y = F.array_position(F.array(*[F.lit(float(c)) for c in classes]), F.col(label).cast("double")) - 1 if classes else F.col(label)
        rows = spread(df.where(F.col(label).isNotNull()).select(
            feature_vector(df, features).alias("x"), y.cast("double").alias("y"), F.lit(0).alias("fold")))
        positive = [None] if not classes else [1] if len(classes) == 2 else list(range(len(classes)))
        machines = [Machine(self.c, gamma, -1, k) for k in positive]
        weights = fit_machines(rows, machines, len(features), self.epsilon, self.n_features, self.seed)
        return Fitted(self.name, features, label, self.problem,
                      _KernelPayload(weights, gamma, positive, classes, self.n_features, self.seed), classes)
