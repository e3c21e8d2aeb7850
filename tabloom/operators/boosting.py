"""Second-order gradient boosting on histograms (M5 multiclass, M9), several models at once.

Features are binned once at exact quantiles.  A level of all trees of a round is one job:
each task adds up gradient, Hessian and row count per (model, class, node, feature, bin) in
NumPy, the tasks' histograms are added, and the driver, which holds only histograms, picks
for every node the split of the largest gain

    T(GL)^2 / (HL + l2) + T(GR)^2 / (HR + l2) - T(G)^2 / (H + l2),  T(G) = sign(G) max(|G| - l1, 0)

above ``gamma`` whose sides have a Hessian of ``min_child_weight``.  Rows with a missing
value go to the side that gains more.  Leaves are -T(G) / (H + l2) * learning_rate.

A level counts only the smaller of two sibling nodes: the other's histograms are those of their parent less these.
Rows find their node by one lookup for several levels (:class:`Paths`).

Objectives: squared error, logistic (two classes) and softmax, where a round grows one tree
per class from the same probabilities.  Models differ in parameters and in the fold they
leave out; all of them share every job, so a search of many candidates has the jobs of one
fit.  Bins and margins are kept in blocks of rows, dealt evenly over the cores, and margins are
rewritten once per round; their lineage is cut in the shared folder every ``CUT`` rounds.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.quantile import quantile_table
from tabloom.functions.vectorsum import block_sum
from tabloom.session import checkpoint_dir, spread

CUT = 10
MAX_BINS = 255
# numbers of one level's histograms: models are fitted in several groups beyond
MAX_STATS = 8_000_000
LEAST_GAIN = 1e-6
# least L2 penalty with which rounding in a difference of sums stays far below LEAST_GAIN
SAFE_L2 = 1e-6
THREADS = 8
LEAST_HESSIAN = 1e-16


@dataclass(frozen=True)
class Boost:
    """Parameters of one model; the defaults are those of the widely used library for this method."""
    rounds: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    seed: int = 0
    # factor of p (1 - p) in the softmax Hessian; None: classes / (classes - 1)
    softmax_factor: float | None = 2.0


@dataclass
class Tree:
    """Nodes of one tree in heap order (children of i are 2 i + 1 and 2 i + 2); feature -1 marks a leaf."""
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    def leaves(self, bins: np.ndarray, missing: int, levels: int, node: np.ndarray | None = None) -> np.ndarray:
        """Node that each row of bins reaches within ``levels`` levels, from ``node`` or the root on."""
        node = np.zeros(len(bins), np.int64) if node is None else node
        if not levels or self.feature[0] < 0:
            return node
        inner = self.feature >= 0
        own = np.arange(len(inner))
        # a leaf is its own child on both sides; kids[2 i + went left]
        kids = np.column_stack((np.where(inner, 2 * own + 2, own), np.where(inner, 2 * own + 1, own))).ravel()
        feature = np.maximum(self.feature, 0).astype(np.int64)
        flat, row = np.ascontiguousarray(bins).ravel(), np.arange(len(bins), dtype=np.int64) * bins.shape[1]
        gone = bool((bins == missing).any())
        for _ in range(levels):
            b = flat.take(row + feature.take(node))
            left = b <= self.bin.take(node)
            if gone:
                left = np.where(b == missing, self.missing_left.take(node), left)
            node = kids.take(2 * node + left)
        return node


class Paths:
    """``values`` of the nodes that rows of bins reach in a tree within ``levels`` levels.

    The first levels are one lookup: a feature's bins between two cuts of theirs go the same ways, and a table holds
    the node of every combination.  It has at most ``size`` cells; the levels below are walked.
    """

    def __init__(self, tree: Tree, levels: int, values: np.ndarray, missing: int, size: int):
        self.tree, self.values, self.missing = tree, values, missing
        self.top, ranks, reps = 0, [], []
        for upto in range(levels, 0, -1):
            inner = np.flatnonzero(tree.feature[:2 ** upto - 1] >= 0)
            cuts = {int(j): np.unique(tree.bin[inner[tree.feature[inner] == j]]) for j in np.unique(tree.feature[inner])}
            if math.prod(len(c) + 2 for c in cuts.values()) <= size:
                self.top, ranks = upto, list(cuts.items())
                break
        self.rest = levels - self.top
        self.ranks, stride, cells = [], 1, math.prod(len(c) + 2 for _, c in ranks)
        grid = np.zeros((cells, int(tree.feature.max(initial=0)) + 1), np.int64)
        for j, c in ranks:
            # a bin's place among the cuts, a missing value's behind them, and a bin of every place
            place = np.searchsorted(c, np.arange(missing + 1), side="left")
            place[missing] = len(c) + 1
            reps = np.append(np.append(c, c[-1] + 1), missing)
            grid[:, j] = reps[np.arange(cells) // stride % len(reps)]
            self.ranks.append((j, place * stride))
            stride *= len(reps)
        node = tree.leaves(grid, missing, self.top)
        self.table = node if self.rest else values.take(node)

    def __call__(self, columns: list[np.ndarray]) -> np.ndarray:
        """``columns``: the bins of each feature as indices."""
        if not self.ranks:
            out = np.full(len(columns[0]), self.table[0], self.table.dtype)
        else:
            at = self.ranks[0][1].take(columns[self.ranks[0][0]])
            for j, place in self.ranks[1:]:
                at += place.take(columns[j])
            out = self.table.take(at)
        if not self.rest:
            return out
        return self.values.take(self.tree.leaves(np.column_stack(columns), self.missing, self.rest, out))


@dataclass
class Forest:
    """A fitted model: trees[round][class], starting margins and the bin edges of the features."""
    params: Boost
    objective: str
    base: np.ndarray
    edges: list[np.ndarray]
    trees: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return bin_values(x, self.edges)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.tile(self.base, (len(x), 1))
        for trees in self.trees:
            for k, t in enumerate(trees):
                out[:, k] += t.value[t.leaves(b, MAX_BINS, self.params.max_depth)]
        return out

    def to_json(self) -> dict:
        return {"params": asdict(self.params), "objective": self.objective, "base": self.base.tolist(),
                "edges": [e.tolist() for e in self.edges],
                "trees": [[{k: v.tolist() for k, v in vars(t).items()} for t in trees] for trees in self.trees]}

    @staticmethod
    def from_json(d: dict) -> "Forest":
        kinds = {"feature": np.int32, "bin": np.int32, "missing_left": bool}
        return Forest(Boost(**d["params"]), d["objective"], np.array(d["base"]), [np.array(e, float) for e in d["edges"]],
                      [[Tree(**{k: np.array(v, kinds.get(k, float)) for k, v in t.items()}) for t in trees] for trees in d["trees"]])

    def gains(self) -> np.ndarray:
        """Total gain per feature."""
        out = np.zeros(len(self.edges))
        for trees in self.trees:
            for t in trees:
                used = t.feature >= 0
                np.add.at(out, t.feature[used], t.gain[used])
        return out


def bin_values(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of edges below each value; MAX_BINS where it is missing."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), MAX_BINS, np.searchsorted(e, x[:, j], side="left"))
    return out


def bin_edges(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending distinct cut values per feature: a value v is in bin (number of cuts < v)."""
    probs = [i / max_bins for i in range(1, max_bins)]
    q = quantile_table(df, features, probs).first()
    return [np.unique(np.array(q[f] or [], float)) for f in features]


def probabilities(margins: np.ndarray, objective: str) -> np.ndarray:
    """Class probabilities (two columns for logistic)."""
    if objective == "logistic":
        p = 1.0 / (1.0 + np.exp(-margins[:, 0]))
        return np.column_stack((1 - p, p))
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, objective: str, factor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian (rows x outputs) of the loss at the margins."""
    if objective == "squared":
        return margins - y[:, None], np.ones_like(margins)
    if objective == "logistic":
        p = 1.0 / (1.0 + np.exp(-margins))
        return p - y[:, None], np.maximum(p * (1 - p), LEAST_HESSIAN)
    p = probabilities(margins, objective)
    k = p.shape[1]
    f = factor if factor is not None else k / (k - 1)
    return p - (y[:, None] == np.arange(k)), np.maximum(f * p * (1 - p), LEAST_HESSIAN)


def mean_loss(margins: np.ndarray, y: np.ndarray, objective: str) -> float:
    if objective == "squared":
        return float(((margins[:, 0] - y) ** 2).mean() / 2)
    p = probabilities(margins, objective)
    return float(-np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-300)).mean())


def _chosen(ids: np.ndarray, share: float, seed: int, round_: int) -> np.ndarray:
    """Rows of a round's subsample: a hash of (row, seed, round) below the share."""
    if share >= 1:
        return np.ones(len(ids), bool)
    return _drawn(ids, seed, round_) < share


def _drawn(ids: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number from 0 to 1 of every row: a hash of (row, seed, round)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + round_ + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / 2.0 ** 53


def _soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(hist: np.ndarray, params: Boost, columns: np.ndarray):
    """Best split of every node from its histograms (nodes, features, bins + missing, 3: G, H, rows).

    Returns (gain, feature, bin, missing_left, left sums, right sums); gain is -inf where none holds.
    Ties go to the smaller feature, bin, then to missing values on the right.
    """
    total = hist[:, 0].sum(axis=1)                              # any feature's bins add up to the node
    cum = np.cumsum(hist[:, columns, :-1], axis=2)[:, :, :-1]   # rows with bin <= b; the last bin leaves nothing
    gone = hist[:, columns, -1][:, :, None]
    # missing right, missing left: the same where none is missing
    left = np.stack((cum, cum + gone), axis=3) if gone.any() else cum[:, :, :, None]
    right = total[:, None, None, None] - left

    def term(s):
        return _soft(s[..., 0], params.l1) ** 2 / (s[..., 1] + params.l2 + 1e-300)

    gain = term(left) + term(right) - term(total)[:, None, None, None]
    bad = (left[..., 1] < params.min_child_weight) | (right[..., 1] < params.min_child_weight) \
        | (left[..., 2] < 0.5) | (right[..., 2] < 0.5) | (gain <= LEAST_GAIN) | (gain < params.gamma)
    gain = np.where(bad, -np.inf, gain)
    n = len(hist)
    if gain.size == 0:
        return np.full(n, -np.inf), *(np.zeros(n, np.int64) for _ in range(2)), np.zeros(n, bool), total, total
    flat = gain.reshape(n, -1).argmax(axis=1)
    f, b, m = np.unravel_index(flat, gain.shape[1:])
    every = np.arange(n)
    return gain[every, f, b, m], columns[f], b, m.astype(bool), left[every, f, b, m], right[every, f, b, m]


# A row of the training state is a block of rows: each column holds the values of one array of theirs (margins
# output by output).  The rounds run on these blocks as an RDD: a level is a short job, and planning it would take longer than running it.
STATE = "b binary, y binary, fold binary, id binary, f binary"
STEP = 50_000       # rows that are counted at a time


def _unpack(blocks, p: int, width: int, step: int = 1):
    """(bins, y, fold, id, margins) of the blocks; blocks of fewer than ``step`` rows are put together."""
    def arrays(parts):
        y, fold, ids = (np.frombuffer(b"".join(x[c] for x in parts), kind) for c, kind in ((1, np.float64), (2, np.int32), (3, np.int64)))
        bins = np.frombuffer(b"".join(x[0] for x in parts), np.uint8).reshape(len(y), p)
        f = [np.frombuffer(x[4], np.float64).reshape(width, -1) for x in parts]
        return bins, y, fold, ids, (f[0] if len(f) == 1 else np.concatenate(f, axis=1)).T

    held, rows = [], 0
    for block in blocks:
        held.append(block)
        rows += len(block[1]) // 8
        if rows >= step:
            yield arrays(held)
            held, rows = [], 0
    if held:
        yield arrays(held)


def _packed(bins, y, fold, ids, margins) -> tuple:
    return tuple(np.ascontiguousarray(v, kind).tobytes() for v, kind in
                 ((bins, np.uint8), (y, np.float64), (fold, np.int32), (ids, np.int64), (margins.T, np.float64)))


def binned(df: DataFrame, features: list[str], label, fold, key, edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """The training state: bins, label, fold, row id and starting margins."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            block = _packed(bin_values(v, edges), batch.column("y").to_numpy(), batch.column("fold").to_numpy(),
                            batch.column("id").to_numpy(), np.tile(base, (len(batch), 1)))
            yield pa.record_batch([pa.array([v], pa.binary()) for v in block], names=["b", "y", "fold", "id", "f"])

    rows = df.select(x.alias("x"), label.cast("double").alias("y"), fold.cast("int").alias("fold"),
                     key.cast("long").alias("id")).where("y is not null")
    return spread(rows).mapInArrow(run, STATE)


def fit_many(state: DataFrame, specs: list[Boost], folds: list[int], edges: list[np.ndarray], objective: str,
             outputs: int, base: np.ndarray, track: list | None = None) -> list[Forest]:
    """Models of ``specs``, each on the rows outside its fold (-1: all rows), from one sequence of jobs.

    ``state``: as from :func:`binned`, with the starting margins of all models side by side.
    ``track``: receives each round's mean training loss of every model.
    """
    p = len(edges)
    n_bins = max((len(e) for e in edges), default=0) + 2        # bins 0..cuts, then missing values
    size = outputs * p * n_bins * 3 * 2 ** max(0, max(s.max_depth for s in specs) - 1)
    m = len(specs)
    if isinstance(state, DataFrame):
        checkpoint_dir(state.sparkSession)
        state = state.rdd.map(tuple)
    forests = [Forest(s, objective, base, edges) for s in specs]
    per = max(1, MAX_STATS // size)
    if m > per:
        parts = []
        for a in range(0, m, per):
            own = slice(a * outputs, (a + per) * outputs)
            cut = state.map(lambda x, own=own: (*x[:4], np.frombuffer(x[4], np.float64).reshape(m * outputs, -1)[own].tobytes()))
            parts += fit_many(cut, specs[a:a + per], folds[a:a + per], edges, objective, outputs, base)
        return parts
    width = m * outputs
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()          # with the first job that reads it
    held = [state]
    for round_ in range(max(s.rounds for s in specs)):
        on = [i for i in range(m) if round_ < specs[i].rounds]
        trees = {i: [Tree.empty(specs[i].max_depth) for _ in range(outputs)] for i in on}
        columns = {i: _columns(p, specs[i], round_) for i in on}
        open_nodes = {(i, k): [0] for i in on for k in range(outputs)}
        above: dict = {}        # histograms of the level above and their nodes
        for level in range(max(specs[i].max_depth for i in on)):
            at = {key: nodes for key, nodes in open_nodes.items() if nodes and level < specs[key[0]].max_depth}
            if not at:
                break
            counted = {(i, k): _smaller(trees[i][k], nodes) if (i, k) in above and specs[i].l2 >= SAFE_L2 else nodes
                       for (i, k), nodes in at.items()}
            hists = _histograms(state, specs, folds, trees, counted, level, round_, objective, outputs, p, n_bins, width)
            # this round's state stands: those before are let go
            for d in held[:-1]:
                d.unpersist()
            del held[:-1]

            def grown(key):
                i, k = key
                hist = _siblings(at[key], counted[key], hists[key], *above[key]) if counted[key] is not at[key] else hists[key]
                return hist, _grow(trees[i][k], specs[i], at[key], hist, columns[i])

            with ThreadPoolExecutor(THREADS) as pool:
                done = dict(zip(at, pool.map(grown, at)))
            above = {key: (at[key], hist) for key, (hist, _) in done.items()}
            open_nodes = {key: nodes for key, (_, nodes) in done.items()}
        for i in on:
            forests[i].trees.append(trees[i])
        state = _advance(state, specs, trees, outputs, p, width).persist(StorageLevel.MEMORY_AND_DISK)
        if (round_ + 1) % CUT == 0:
            state.checkpoint()
        held.append(state)
        if track is not None:
            track.append(_losses(state, folds, objective, outputs, p, width))
    for d in held:
        d.unpersist()
    return forests


def _smaller(tree: Tree, nodes: list[int]) -> list[int]:
    """Of every two siblings the one of fewer rows."""
    return [a if tree.cover[a] <= tree.cover[b] else b for a, b in zip(nodes[::2], nodes[1::2])]


def _siblings(nodes: list[int], counted: list[int], hist: np.ndarray, parents: list[int], above: np.ndarray) -> np.ndarray:
    """Histograms of ``nodes``, pairs of siblings: those of one are counted, the other's are what its parent has more."""
    rows = above[np.searchsorted(parents, (np.array(nodes[::2]) - 1) // 2)] - hist
    rows[..., :2] *= rows[..., 2:] > 0.5        # where no row is left, so is no rounding
    left = (np.array(counted) == np.array(nodes[::2]))[:, None, None, None]
    out = np.empty((len(nodes), *hist.shape[1:]))
    out[::2], out[1::2] = np.where(left, hist, rows), np.where(left, rows, hist)
    return out


def _columns(p: int, spec: Boost, round_: int) -> np.ndarray:
    """Features of a round's trees."""
    k = max(1, math.ceil(p * spec.colsample - 1e-9))
    if k >= p:
        return np.arange(p)
    return np.sort(np.random.default_rng([spec.seed, round_]).permutation(p)[:k])


def _histograms(state, specs, folds, trees, at, level, round_, objective, outputs, p, n_bins, width):
    """(model, class) -> (nodes, features, bins, 3) sums of G, H and rows at the open nodes."""
    keys = list(at)
    sizes = [len(at[key]) * p * n_bins * 3 for key in keys]
    begin = np.concatenate(([0], np.cumsum(sizes)))

    # heap node -> first cell of its histograms; a node that is not open counts beside them
    places = []
    for i, k in keys:
        place = np.full(len(trees[i][k].feature), len(at[i, k]) * n_bins, np.int64)
        place[at[i, k]] = np.arange(len(at[i, k])) * n_bins
        places.append(place)

    def add(blocks):
        out, paths = np.zeros(int(begin[-1])), {}
        for part in _unpack(blocks, p, width, STEP):
            _count(out, paths, *part)
        return out

    def _count(out, paths, bins, y, fold, ids, f):
        whole = _indices(bins)
        drawn, own = {}, None
        for s, (i, k) in enumerate(keys):
            if own is None or own[0] != i:
                member = fold != folds[i]
                if specs[i].subsample < 1:
                    if specs[i].seed not in drawn:
                        drawn[specs[i].seed] = _drawn(ids, specs[i].seed, round_)
                    member &= drawn[specs[i].seed] < specs[i].subsample
                rows = None if member.all() else np.flatnonzero(member)
                columns = whole if rows is None else [c.take(rows) for c in whole]
                # all outputs of a softmax model need each other's margins
                held = outputs > 1 and gradients(*_of(rows, f[:, i * outputs:(i + 1) * outputs], y), objective, specs[i].softmax_factor)
                own = (i, rows, columns, held)
            _, rows, columns, held = own
            n = len(at[i, k])
            if level:
                # tables pay where they are no larger than the rows
                if s not in paths:
                    paths[s] = Paths(trees[i][k], level, places[s], MAX_BINS, max(1024, len(columns[0])))
                cell = paths[s](columns)
                here = np.flatnonzero(cell < n * n_bins)
                if len(here) < len(cell):
                    cell, columns = cell.take(here), [c.take(here) for c in columns]
                    rows = here if rows is None else rows.take(here)
                    held = held and (held[0].take(here, axis=0), held[1].take(here, axis=0))
            else:
                cell = np.zeros(len(columns[0]), np.int64)
            g, h = held or gradients(*_of(rows, f[:, i:i + 1], y), objective, specs[i].softmax_factor)
            gk, hk = np.ascontiguousarray(g[:, k]), np.ascontiguousarray(h[:, k])
            block = out[begin[s]:begin[s + 1]].reshape(p, 3, n * n_bins)
            for j in range(p):
                code = columns[j]
                if len(code) and code.max() == MAX_BINS:
                    code = np.where(code == MAX_BINS, n_bins - 1, code)
                idx = cell + code
                for c, w in enumerate((gk, hk, None)):
                    block[j, c] += np.bincount(idx, weights=w, minlength=n * n_bins)

    total = block_sum(state, add, int(begin[-1]))
    return {key: np.ascontiguousarray(total[a:b].reshape(p, 3, len(at[key]), n_bins).transpose(2, 0, 3, 1))
            for key, a, b in zip(keys, begin[:-1], begin[1:])}


def _indices(bins: np.ndarray) -> list[np.ndarray]:
    return [bins[:, j].astype(np.intp) for j in range(bins.shape[1])]


def _of(rows: np.ndarray | None, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and labels of the rows."""
    return (margins, y) if rows is None else (np.column_stack([m.take(rows) for m in margins.T]), y.take(rows))


def _grow(tree: Tree, spec: Boost, nodes: list[int], hist: np.ndarray, columns: np.ndarray) -> list[int]:
    """Split the open nodes where it gains; returns the children that may split at the next level."""
    gain, feature, bin_, missing_left, left, right = best_splits(hist, spec, columns)
    total = hist[:, 0].sum(axis=1)
    out = []
    for s, node in enumerate(nodes):
        tree.cover[node] = total[s, 2]
        tree.value[node] = _leaf(total[s], spec)
        if gain[s] == -np.inf:
            continue
        tree.feature[node], tree.bin[node], tree.missing_left[node] = feature[s], bin_[s], missing_left[s]
        tree.gain[node] = gain[s]
        for child, sums in ((2 * node + 1, left[s]), (2 * node + 2, right[s])):
            tree.cover[child], tree.value[child] = sums[2], _leaf(sums, spec)
            out.append(child)
    return out


def _leaf(sums: np.ndarray, spec: Boost) -> float:
    return float(-_soft(sums[0], spec.l1) / (sums[1] + spec.l2 + 1e-300) * spec.learning_rate)


def _advance(state: RDD, specs, trees, outputs, p, width) -> RDD:
    """The state with the new trees' values added to the margins."""
    def run(blocks):
        paths = {}
        for bins, y, fold, ids, f in _unpack(blocks, p, width, STEP):
            f, columns = f.copy(order="F"), _indices(bins)
            for i, own in trees.items():
                for k, t in enumerate(own):
                    if (i, k) not in paths:
                        paths[i, k] = Paths(t, specs[i].max_depth, t.value, MAX_BINS, max(1024, len(y)))
                    f[:, i * outputs + k] += paths[i, k](columns)
            yield _packed(bins, y, fold, ids, f)

    return state.mapPartitions(run, preservesPartitioning=True)


def _losses(state, folds, objective, outputs, p, width) -> list[float]:
    m = len(folds)

    def add(blocks):
        out = np.zeros(2 * m)
        for _, y, fold, _, f in _unpack(blocks, p, width):
            for i in range(m):
                own = fold != folds[i]
                if own.any():
                    out[2 * i] += own.sum()
                    out[2 * i + 1] += own.sum() * mean_loss(f[own][:, i * outputs:(i + 1) * outputs], y[own], objective)
        return out

    s = block_sum(state, add, 2 * m).reshape(m, 2)
    return [float(b / a) if a else float("nan") for a, b in s]


# ---------------------------------------------------------------- learner

class BoostedPayload:
    """A fitted forest behind ``transform``: one Arrow UDF over the feature columns."""

    def __init__(self, forest: Forest, problem: str, classes: list):
        self.forest, self.problem, self.classes = forest, problem, classes
        gains = forest.gains()
        self.featureImportances = DenseVector(gains / gains.sum() if gains.sum() else gains)

    def transform(self, df: DataFrame, fitted) -> DataFrame:
        forest, problem = self.forest, self.problem

        @F.pandas_udf("array<double>")
        def score(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([pd.to_numeric(c).to_numpy(float, na_value=np.nan) for c in cols])
            f = forest.margins(x)
            return pd.Series(list(f if problem == "regression" else probabilities(f, forest.objective)))

        out = df.withColumn("_boosted", score(*[F.col(c).cast("double") for c in fitted.features]))
        if problem == "regression":
            return out.withColumn("prediction", F.col("_boosted")[0]).drop("_boosted")
        best = F.array_position("_boosted", F.array_max("_boosted")).cast("int")
        names = F.array(*[F.lit(float(c)) for c in self.classes])
        return out.withColumn("prediction", F.element_at(names, best)) \
            .withColumn("probability", array_to_vector("_boosted")).drop("_boosted")


def starting_margins(df: DataFrame, label: str, objective: str, classes: list) -> np.ndarray:
    """Margins before the first round: the mean, the log odds of two classes, 0 for each of more."""
    if objective == "squared":
        return np.array([float(df.agg(F.avg(label)).first()[0] or 0.0)])
    if objective == "softmax":
        return np.zeros(len(classes))
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.get(c, 0) for c in classes)
    share = np.array([max(counts.get(c, 0), 1e-9) / max(n, 1) for c in classes])
    return np.array([math.log(share[1] / share[0])])


class Boosted:
    """Gradient boosting for regression, two classes (logistic) and more (softmax): labels 0..k-1."""

    def __init__(self, name: str, problem: str, params: Boost = Boost(), max_bins: int = MAX_BINS):
        self.name, self.problem, self.params, self.max_bins = name, problem, params, max_bins

    def fit(self, df: DataFrame, features: list[str], label: str, track: list | None = None):
        from tabloom.operators.models import Fitted, class_labels
        classes = class_labels(df, label) if self.problem == "classification" else []
        objective = "squared" if self.problem == "regression" else "logistic" if len(classes) <= 2 else "softmax"
        outputs = len(classes) if objective == "softmax" else 1
        edges = bin_edges(df, features, self.max_bins)
        y = F.col(label)
        if self.problem == "classification":
            y = F.array_position(F.array(*[F.lit(float(c)) for c in classes]), y.cast("double")) - 1
            if len(classes) < 2:
                classes = [*classes, *([1.0] if classes and classes[0] != 1 else [2.0])][:2] if classes else [0.0, 1.0]
        base = starting_margins(df.where(F.col(label).isNotNull()), label, objective, classes)
        state = binned(df, features, y, F.lit(0), F.xxhash64(*features, label), edges, base)
        forest = fit_many(state, [self.params], [-1], edges, objective, outputs, base, track)[0]
        return Fitted(self.name, features, label, self.problem, BoostedPayload(forest, self.problem, classes), classes)

    def with_params(self, **values) -> "Boosted":
        return Boosted(self.name, self.problem, replace(self.params, **values), self.max_bins)


def score_folds(rows: DataFrame, forests: list[Forest], folds: list[int], candidate: list[int], problem: str) -> DataFrame:
    """candidate, fold, y, pred, score of every held-out row and model (score: probability of class 1).

    ``rows``: x array<double>, y, fold.
    """
    from tabloom.operators.batchfit import SCORES

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for forest, f, c in zip(forests, folds, candidate):
                here = np.flatnonzero(fold == f)
                if not len(here):
                    continue
                m = forest.margins(x[here])
                if problem == "regression":
                    pred = score = m[:, 0]
                else:
                    p = probabilities(m, forest.objective)
                    pred, score = p.argmax(axis=1).astype(float), p[:, 1]
                yield pa.record_batch([pa.array(np.full(len(here), c, np.int32)), pa.array(np.full(len(here), f, np.int32)),
                                       pa.array(y[here]), pa.array(pred), pa.array(score)],
                                      names=["candidate", "fold", "y", "pred", "score"])

    return rows.mapInArrow(run, SCORES)
