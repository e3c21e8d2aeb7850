"""Exact k-nearest neighbours without a cross join (M7; also used by SMOTE and ENN).

Queries and reference rows are hashed into blocks.  Each query block meets
each reference block in one ``cogroup`` task, where NumPy computes the
block's distances in bounded chunks and emits only the ``k`` best
candidates per query; a per-query merge then keeps the final ``k``.  No
task holds more than one query block and one reference block, no pair is
ever emitted as a row, and the result is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.scan import row_numbers
from tabloom.operators.models import Fitted
from tabloom.session import cut_lineage

BLOCK_ROWS = 20_000     # rows per block on each side
CHUNK_CELLS = 4_000_000  # distance-matrix cells per NumPy chunk
TILE_CELLS = 32_768      # cells that are summed over all dimensions at a time: two such arrays fit a core's cache
TILE_REFS = 2_048        # references of a tile
PRODUCT_DIMS = 12        # dimensions from which a matrix product finds the cells worth an exact sum
LEAST_BLOCK = 500        # rows a side: smaller blocks cost more to deal out than they spread
BLOCKS_PER_CORE = 4
MOST_PARTS = 4096        # tasks of one search


def _vec(df: DataFrame, features: list[str]):
    if len(features) == 1 and df.schema[features[0]].dataType.simpleString().startswith("array"):
        return F.col(features[0]).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def _distances(a: np.ndarray, rv: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Distances of a chunk of queries to all references, summed dimension by dimension.

    The left-to-right sum gives the same doubles as Spark's ``aggregate`` over
    ``zip_with`` and as DuckDB's ``list_distance``, so ties are real ties.
    Tiles that stay in a core's cache are summed over all dimensions at once.
    """
    out = np.empty((a.shape[0], rv.shape[0]))
    wide = min(TILE_REFS, max(1, rv.shape[0]))
    high = max(1, TILE_CELLS // wide)
    buf = np.empty((high, wide))
    for c in range(0, rv.shape[0], wide):
        rt = np.ascontiguousarray(rv[c:c + wide].T)
        for r in range(0, a.shape[0], high):
            q = a[r:r + high]
            acc = np.zeros((q.shape[0], rt.shape[1]))
            diff = buf[:q.shape[0], :rt.shape[1]]
            for j in range(a.shape[1]):
                np.subtract(q[:, j, None], rt[None, j], out=diff)
                if metric == "euclidean":
                    diff *= diff
                elif metric == "manhattan":
                    np.abs(diff, out=diff)
                elif metric == "chebyshev":
                    np.maximum(acc, np.abs(diff, out=diff), out=acc)
                    continue
                else:
                    np.power(np.abs(diff, out=diff), p, out=diff)
                acc += diff
            out[r:r + high, c:c + wide] = acc
    return _rooted(out, metric, p)


def _rooted(acc: np.ndarray, metric: str, p: float) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(acc)
    if metric in ("manhattan", "chebyshev"):
        return acc
    return acc ** (1.0 / p)


def _near_cells(a: np.ndarray, rv: np.ndarray, own: np.ndarray, others: np.ndarray, k: int, apart) -> tuple:
    """(rows, cols, exact distances) of every reference that may be among a query's ``k`` nearest (Euclidean).

    One matrix product gives the squares to within ``slack``, a bound on its rounding and on that of the
    exact sums; what lies within it of the k-th smallest is summed dimension by dimension as in
    :func:`_distances`.  ``own``, ``others``: squared lengths.  ``apart``: cells that are no neighbours.
    """
    near = a @ rv.T
    near *= -2.0
    near += own[:, None]
    near += others[None, :]
    if apart is not None:
        near[apart] = np.inf
    slack = 16 * (a.shape[1] + 8) * np.finfo(float).eps * (own + others.max())
    upto = np.partition(near, k - 1, axis=1)[:, k - 1] + slack
    rows, cols = np.nonzero(near <= upto[:, None])
    dist = np.empty(len(rows))
    for s in range(0, len(rows), TILE_CELLS):
        q, r = a[rows[s:s + TILE_CELLS]], rv[cols[s:s + TILE_CELLS]]
        acc = np.zeros(len(q))
        for j in range(a.shape[1]):
            diff = q[:, j] - r[:, j]
            acc += diff * diff
        dist[s:s + TILE_CELLS] = np.sqrt(acc)
    if apart is not None:
        dist[apart[rows, cols]] = np.inf
    return rows, cols, dist


def _topk_fn(k: int, metric: str, p: float, exclude_self: bool):
    """Per cogroup: the ``k`` best references of each query by ``(distance, reference key)``."""
    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qkey": pd.Series([], dtype="int64"), "rkey": pd.Series([], dtype="int64"),
                              "dist": pd.Series([], dtype="float64")})
        if q.empty or r.empty:
            return empty
        qv = np.stack(q["v"].to_numpy()).astype(np.float64)
        rv = np.stack(r["v"].to_numpy()).astype(np.float64)
        qk = q["qkey"].to_numpy()
        rk = r["rkey"].to_numpy()
        kk = min(k + (1 if exclude_self else 0), len(rk))
        chunk = max(1, CHUNK_CELLS // max(len(rk), 1))
        outs = []
        with np.errstate(over="ignore", invalid="ignore"):
            own, others = (qv * qv).sum(axis=1), (rv * rv).sum(axis=1)
            product = metric == "euclidean" and rv.shape[1] >= PRODUCT_DIMS and np.isfinite(4 * (own.max() + others.max()))
        for s in range(0, len(qk), chunk):
            apart = qk[s:s + chunk, None] == rk[None, :] if exclude_self else None
            if product:
                rows, cols, dist = _near_cells(qv[s:s + chunk], rv, own[s:s + chunk], others, kk, apart)
            else:
                d = _distances(qv[s:s + chunk], rv, metric, p)
                if exclude_self:
                    d = np.where(apart, np.inf, d)
                # every element up to the kk-th smallest distance (ties included), then exact order
                thr = np.partition(d, kk - 1, axis=1)[:, kk - 1]
                rows, cols = np.nonzero(d <= thr[:, None])
                dist = d[rows, cols]
            order = np.lexsort((rk[cols], dist, rows))
            rows, cols, dist = rows[order], cols[order], dist[order]
            starts = np.searchsorted(rows, np.arange(len(qk[s:s + chunk])))
            pos = np.arange(len(rows)) - starts[rows]
            keep = (pos < kk) & np.isfinite(dist)
            outs.append(pd.DataFrame({"qkey": qk[s:s + chunk][rows[keep]], "rkey": rk[cols[keep]],
                                      "dist": dist[keep]}))
        return pd.concat(outs, ignore_index=True) if outs else empty
    return fn


GRID_MAX_DIMS = 8        # grid pruning pays off only for low-dimensional features
GRID_ROWS_PER_CELL = 512  # target reference rows per grid cell
OFFSETS = [-1, 0, 1]


def _blocked_candidates(q: DataFrame, r: DataFrame, k: int, metric: str, p: float, exclude_self: bool,
                        block_rows: int) -> DataFrame:
    """Every query block against every reference block: top-k per query per block (brute force)."""
    nq = q.count()
    nr = r.count() if nq else 0
    if nq == 0 or nr == 0:   # e.g. every query already settled on the grid
        return q.sparkSession.createDataFrame([], "qkey bigint, rkey bigint, dist double")
    # blocks of at most ``block_rows``, smaller where these would leave cores idle
    cores = q.sparkSession.sparkContext.defaultParallelism
    block_rows = min(block_rows, max(LEAST_BLOCK, math.isqrt(nq * nr // (cores * BLOCKS_PER_CORE))))
    bq, br = max(1, math.ceil(nq / block_rows)), max(1, math.ceil(nr / block_rows))
    parts = min(bq * br, MOST_PARTS)
    q_rep = q.withColumn("qb", F.pmod(F.xxhash64("qkey"), F.lit(bq)).cast("int")) \
             .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(br - 1))))
    r_rep = r.withColumn("rb", F.pmod(F.xxhash64("rkey"), F.lit(br)).cast("int")) \
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    # dealt by number: a block of few bytes is many sums, so blocks must not be put together by their size
    q_rep, r_rep = (d.repartition(parts, "qb", "rb") for d in (q_rep, r_rep))
    return (q_rep.groupBy("qb", "rb").cogroup(r_rep.groupBy("qb", "rb"))
            .applyInPandas(_topk_fn(k, metric, p, exclude_self), "qkey bigint, rkey bigint, dist double"))


def _grid_candidates(q: DataFrame, r: DataFrame, k: int, metric: str, p: float, exclude_self: bool,
                     block_rows: int, dims: int):
    """Exact candidates from the 3x3 neighbouring cells of a grid on the two widest dimensions.

    Returns ``(candidates, resolved)``: ``resolved`` lists the queries whose
    k-th candidate lies within the cell width ``w``.  Every point outside
    the 3x3 block is at least ``w`` away (any Lp norm), so those k are exact.
    Dense cells are split into hash sub-blocks on both sides, so no group
    holds more than ``block_rows`` rows of either side.
    Returns ``None`` when the data give no usable grid.
    """
    st = r.agg(F.count(F.lit(1)).alias("n"),
               *[F.min(F.col("v")[j]).alias(f"lo{j}") for j in range(dims)],
               *[F.max(F.col("v")[j]).alias(f"hi{j}") for j in range(dims)]).collect()[0]
    spans = sorted(((st[f"hi{j}"] - st[f"lo{j}"], j) for j in range(dims)
                    if st[f"hi{j}"] is not None and st[f"hi{j}"] > st[f"lo{j}"]), reverse=True)[:2]
    if not spans or not st["n"]:
        return None
    per_cell = max(8 * k, GRID_ROWS_PER_CELL)
    cells = max(1.0, st["n"] / per_cell)
    area = 1.0
    for span, _ in spans:
        area *= span
    w = (area / cells) ** (1.0 / len(spans))
    axes = [j for _, j in spans]

    def cell(j):
        return F.floor((F.col("v")[j] - F.lit(st[f"lo{j}"])) / F.lit(w)).cast("bigint")

    qc = q.select("qkey", "v", *[cell(j).alias(f"c{i}") for i, j in enumerate(axes)])
    shifts = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(combo)])
                       for combo in _combos(len(axes))])
    rc = r.select("rkey", "v", *[cell(j).alias(f"b{i}") for i, j in enumerate(axes)], F.explode(shifts).alias("s"))
    rc = rc.select("rkey", "v", *[(F.col(f"b{i}") + F.col(f"s.o{i}")).alias(f"c{i}") for i in range(len(axes))])
    ck = [f"c{i}" for i in range(len(axes))]
    sizes = (qc.groupBy(*ck).agg(F.count(F.lit(1)).alias("nq"))
             .join(rc.groupBy(*ck).agg(F.count(F.lit(1)).alias("nr")), ck)
             .select(*ck, F.ceil(F.col("nq") / block_rows).cast("int").alias("bq"),
                     F.ceil(F.col("nr") / block_rows).cast("int").alias("br")))
    q_rep = qc.join(sizes, ck).withColumn("qs", F.pmod(F.xxhash64("qkey"), F.col("bq")).cast("int")) \
              .withColumn("rs", F.explode(F.sequence(F.lit(0), F.col("br") - 1))).select("qkey", "v", *ck, "qs", "rs")
    r_rep = rc.join(sizes, ck).withColumn("rs", F.pmod(F.xxhash64("rkey"), F.col("br")).cast("int")) \
              .withColumn("qs", F.explode(F.sequence(F.lit(0), F.col("bq") - 1))).select("rkey", "v", *ck, "qs", "rs")
    keys = [*ck, "qs", "rs"]
    cand = (q_rep.groupBy(*keys).cogroup(r_rep.groupBy(*keys))
            .applyInPandas(_topk_fn(k, metric, p, exclude_self), "qkey bigint, rkey bigint, dist double"))
    wq = Window.partitionBy("qkey").orderBy("dist", "rkey")
    top = cand.withColumn("_rank", F.row_number().over(wq)).where(F.col("_rank") <= k)
    whole = Window.partitionBy("qkey")
    flagged = top.withColumn("_ok", (F.count(F.lit(1)).over(whole) >= k) &
                             (F.max("dist").over(whole) <= F.lit(w * (1 - 1e-6)))).drop("_rank")
    # k rows per query, read twice below: materialise once in the shared checkpoint folder
    flagged = cut_lineage(flagged)
    return flagged.where(F.col("_ok")).drop("_ok"), flagged.where(F.col("_ok")).select("qkey").distinct()


DUP_GAIN = 0.5  # thin duplicate positions when that keeps at most this share of reference rows


def _thin_duplicates(r: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` reference rows per identical feature vector (the smallest keys).

    Rows at one position are all at the same distance from any query and
    ties go to the smaller key, so no query ever needs more than ``k`` of
    them (``k + 1`` when a query may meet itself): the result stays exact.
    ``row_number() <= keep`` over ``partition by v`` is planned with a
    partial ``WindowGroupLimit`` before the shuffle, so even a position that
    holds a third of all rows sends only ``keep`` rows per map task.  A
    HyperLogLog count decides whether duplicates are common enough to pay
    for the extra shuffle; continuous features skip it.
    """
    st = r.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("d")).collect()[0]
    if not st["n"] or keep * st["d"] > DUP_GAIN * st["n"]:
        return r
    w = Window.partitionBy("v").orderBy("rkey")
    thin = r.withColumn("_dn", F.row_number().over(w)).where(F.col("_dn") <= keep).drop("_dn")
    # small by construction and read several times by the search: materialise once
    return cut_lineage(thin)


def _combos(n: int) -> list[tuple]:
    out = [()]
    for _ in range(n):
        out = [c + (o,) for c in out for o in OFFSETS]
    return out


def _dims(df: DataFrame, features: list[str]) -> int:
    if len(features) == 1 and df.schema[features[0]].dataType.simpleString().startswith("array"):
        first = df.select(F.size(F.col(features[0]))).where(F.col(features[0]).isNotNull()).first()
        return int(first[0]) if first else 0
    return len(features)


def neighbours(query: DataFrame, qkey: str, ref: DataFrame, rkey: str, features: list[str], k: int = 5,
               metric: str = "euclidean", p: float = 2.0, exclude_self: bool = False,
               block_rows: int = BLOCK_ROWS, grid: bool | None = None) -> DataFrame:
    """``(qkey, rkey, dist, rank)``: the ``k`` nearest reference rows of every query row.

    Keys must be bigint and unique per side.  Ties are broken by reference key.
    Low-dimensional features first try the exact grid path; queries it
    cannot settle (and all high-dimensional data) use blocked brute force.
    Repeated feature vectors are searched once: the reference keeps the
    ``k`` smallest keys per position and, when queries repeat, each distinct
    query position is searched once and its answer joined back.
    The search reads both inputs several times (statistics, grid sizes,
    blocks): pass materialised tables (see :func:`tabloom.session.cut_lineage`).
    """
    q = query.select(F.col(qkey).cast("bigint").alias("qkey"), _vec(query, features).alias("v"))
    r = ref.select(F.col(rkey).cast("bigint").alias("rkey"), _vec(ref, features).alias("v"))
    keep = k + (1 if exclude_self else 0)
    r = _thin_duplicates(r, keep)
    dims = _dims(ref, features)
    use_grid = grid if grid is not None else (0 < dims <= GRID_MAX_DIMS)
    pos = _query_positions(q)
    if pos is None:
        return _search(q, r, k, metric, p, exclude_self, block_rows, use_grid, dims)
    # One search per distinct query position.  Without self-exclusion its k
    # best are every such query's k best; with it, the k best apart from the
    # query itself lie among the position's k + 1 best.
    top = _search(pos, r, keep, metric, p, False, block_rows, use_grid, dims)
    lists = top.select(F.col("qkey").alias("_pid"), "rkey", "dist") \
               .join(pos.select(F.col("qkey").alias("_pid"), "v"), "_pid").drop("_pid")
    cand = q.join(lists, "v").drop("v")
    if exclude_self:
        cand = cand.where(F.col("qkey") != F.col("rkey"))
    w = Window.partitionBy("qkey").orderBy("dist", "rkey")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _query_positions(q: DataFrame) -> DataFrame | None:
    """``(v, qkey)`` with one id per distinct query vector, or ``None`` when queries rarely repeat."""
    st = q.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("d")).collect()[0]
    if not st["n"] or st["d"] > DUP_GAIN * st["n"]:
        return None
    # the smallest query key at a position names it: unique because query keys are;
    # at most half the query rows by the check above, read by the search and the join back
    return cut_lineage(q.groupBy("v").agg(F.min("qkey").alias("qkey")))


def _search(q: DataFrame, r: DataFrame, k: int, metric: str, p: float, exclude_self: bool,
            block_rows: int, use_grid: bool, dims: int) -> DataFrame:
    got = _grid_candidates(q, r, k, metric, p, exclude_self, block_rows, dims) if use_grid else None
    if got is None:
        cand = _blocked_candidates(q, r, k, metric, p, exclude_self, block_rows)
    else:
        top, resolved = got
        rest = q.join(resolved, "qkey", "left_anti")
        cand = top.unionByName(_blocked_candidates(rest, r, k, metric, p, exclude_self, block_rows))
    w = Window.partitionBy("qkey").orderBy("dist", "rkey")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _KNNPayload:
    def __init__(self, train: DataFrame, key: str, classes: list, learner: "KNNLearner"):
        self.train, self.key, self.classes, self.learner = train, key, classes, learner

    def transform(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        lr = self.learner
        qk = "_knn_qkey"
        # read by the search and by the final join: key the query rows once
        q = cut_lineage(_with_key(df, qk, lr.key_cols))
        nb = neighbours(q, qk, self.train, self.key, fitted.features, lr.k, lr.metric, lr.p)
        lab = self.train.select(F.col(self.key).cast("bigint").alias("rkey"), F.col(fitted.label).cast("double").alias("_lab"))
        nb = nb.join(lab, "rkey")
        if lr.weights == "distance":
            wexpr = F.when(F.col("dist") == 0, F.lit(1e300)).otherwise(1.0 / F.col("dist"))
        else:
            wexpr = F.lit(1.0)
        nb = nb.withColumn("_w", wexpr)
        if lr.problem == "classification":
            votes = nb.groupBy("qkey", "_lab").agg(F.sum("_w").alias("_s"))
            agg = votes.groupBy("qkey").agg(
                F.min(F.struct((-F.col("_s")).alias("n"), F.col("_lab").alias("l"))).alias("_best"),
                F.map_from_entries(F.collect_list(F.struct("_lab", "_s"))).alias("_m"),
                F.sum("_s").alias("_t"))
            cls = F.array(*[F.lit(float(c)) for c in self.classes])
            probs = F.transform(cls, lambda c: F.coalesce(F.element_at(F.col("_m"), c), F.lit(0.0)) / F.col("_t"))
            from pyspark.ml.functions import array_to_vector
            pred = agg.select(F.col("qkey").alias(qk), F.col("_best.l").alias("prediction"),
                              array_to_vector(probs).alias("probability"))
        else:
            pred = nb.groupBy("qkey").agg((F.sum(F.col("_w") * F.col("_lab")) / F.sum("_w")).alias("prediction")) \
                     .withColumnRenamed("qkey", qk)
        return q.join(pred, qk, "left").drop(qk)


def _with_key(df: DataFrame, name: str, key_cols: list[str] | None) -> DataFrame:
    return unique_key(df, name, key_cols)


def unique_key(df: DataFrame, name: str, key_cols: list[str] | None = None) -> DataFrame:
    """Append ``name``: a unique bigint id per row.

    One integral key column is used as it is.  Otherwise the id is the
    1-based position of the row in ``(xxhash64(key), key)`` order, computed
    with the distributed row numbers of :mod:`tabloom.functions.scan`: exact
    (a 64-bit hash alone collides at around 10^10 rows), deterministic for a
    unique key, and the hash order spreads rows evenly over the buckets.
    Without ``key_cols`` all (orderable) columns form the key; identical rows
    then get distinct ids in no particular order.
    """
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if key_cols and len(key_cols) == 1 and isinstance(df.schema[key_cols[0]].dataType, integral):
        return df.withColumn(name, F.col(key_cols[0]).cast("bigint"))
    if key_cols and all(isinstance(df.schema[c].dataType, integral) for c in key_cols):
        packed = _packed_key(df, key_cols)
        if packed is not None:
            return df.withColumn(name, packed)
    cols = list(key_cols or df.columns)
    orderable = [c for c in cols if not isinstance(df.schema[c].dataType, (T.MapType, T.UserDefinedType))]
    hashed = df.withColumn("_uk_h", F.xxhash64(*cols))
    return row_numbers(hashed, ["_uk_h", *orderable], name=name).drop("_uk_h")


def _packed_key(df: DataFrame, key_cols: list[str]):
    """Integral key columns packed into one bigint (mixed radix over their ranges), if 63 bits hold them.

    One aggregate without a shuffle; ``None`` when a column has nulls or the
    ranges need more bits, so the caller falls back to row numbers.
    """
    st = df.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(key_cols)],
                *[F.max(c).alias(f"hi{i}") for i, c in enumerate(key_cols)],
                *[F.count_if(F.col(c).isNull()).alias(f"nn{i}") for i, c in enumerate(key_cols)]).collect()[0]
    expr, radix = F.lit(0).cast("bigint"), 1
    for i, c in enumerate(key_cols):
        if st[f"nn{i}"] or st[f"lo{i}"] is None:
            return None
        expr = expr + (F.col(c).cast("bigint") - F.lit(st[f"lo{i}"])) * F.lit(radix)
        radix *= st[f"hi{i}"] - st[f"lo{i}"] + 1
        if radix >= 2 ** 63:
            return None
    return expr


class KNNLearner:
    """k-nearest-neighbour classifier/regressor (k=5, euclidean, uniform weights by default).

    ``key_cols`` name a unique key of the rows (used to pair rows with their
    neighbours); fitting only remembers the training table.
    """

    def __init__(self, problem: str, k: int = 5, metric: str = "euclidean", weights: str = "uniform",
                 p: float = 2.0, key_cols: list[str] | None = None):
        self.name = "KNN"
        self.problem, self.k, self.metric, self.weights, self.p = problem, k, metric, weights, p
        self.key_cols = key_cols

    def fit(self, df: DataFrame, features: list[str], label: str) -> Fitted:
        key = "_knn_rkey"
        # a fitted kNN model is its keyed training table, materialised once in the shared folder
        train = cut_lineage(_with_key(df, key, self.key_cols))
        classes = sorted(r[0] for r in train.select(label).distinct().collect()) if self.problem == "classification" else []
        return Fitted("KNN", features, label, self.problem, _KNNPayload(train, key, classes, self), classes)
