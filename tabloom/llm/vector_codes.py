"""Product-quantised vector codes by dual-tree Lloyd rounds in exact integers.

Components become floor(SCALE * x); vectors are cut into ``PARTS`` equal parts and every
part position has a codebook of ``ENTRIES`` entries.  Rows are held in blocks, written
once to the shared folder with one tree per block and position: nodes halve at the median
of their widest component and keep their bounding box and the sum of their parts.  A
round walks those trees together with a tree over the entries:

- a (node, entry node) pair is dropped when its least distance exceeds the least of the
  node's greatest distances, and, between single entries, when the difference of the two
  distances keeps its sign over the node's box;
- a node with one entry left is assigned whole, from its cached sum and count;
- parts of leaves with several entries left are compared by their integer distances.

Boxes, bounds and distances are 64-bit integers, so ties are exact (lower index wins) and
the result does not depend on blocks or tasks.  Each round is one job that returns at most
PARTS * ENTRIES sums to the driver; entries become floor(sum / count), unused ones stay.

Rows whose vector is null or holds null or non-finite components are dropped, no others.
Vectors are padded with zeros to the longest length, rounded up to a multiple of PARTS
(the given ones are all of one such length).  First entries: the rows of the smallest
vec_ids, ties by vector, null vec_ids last; with fewer rows there are fewer entries.
Repeated rows count as often as they stand there.  Null labels form one group.  No rows
kept: no rows out.  Extra columns are not read.  Components whose integer distances would
not fit 64 bits raise an error (beyond about +-8000 at 64 dimensions).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tabloom.llm.common import written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LEAF = 32
# bytes of integers in one block
BLOCK_BYTES = 16 << 20


def levels_of(n: int, leaf: int = LEAF) -> int:
    """Halvings until a node has at most ``leaf`` rows; none is left without a row."""
    return min(math.ceil(math.log2(n / leaf)), n.bit_length() - 1) if n > leaf else 0


def bounds_of(n: int, levels: int) -> list[np.ndarray]:
    """Places at which the nodes of each level begin, with n at the end: every node halves."""
    out = [np.array([0, n])]
    for _ in range(levels):
        b = out[-1]
        half = b[:-1] + (np.diff(b) + 1) // 2
        out.append(np.append(np.column_stack((b[:-1], half)).ravel(), n))
    return out


def build_tree(x: np.ndarray, leaf: int = LEAF):
    """(order, lo, hi, sums) of the parts ``x``; nodes are listed level by level."""
    n = len(x)
    order, boxes = np.arange(n), []
    bounds = bounds_of(n, levels_of(n, leaf))
    for k, b in enumerate(bounds):
        y = x[order]
        lo, hi = np.minimum.reduceat(y, b[:-1]), np.maximum.reduceat(y, b[:-1])
        boxes.append((lo, hi, np.add.reduceat(y, b[:-1])))
        if k < len(bounds) - 1:
            node = np.repeat(np.arange(len(b) - 1), np.diff(b))
            widest = np.argmax(hi - lo, axis=1)
            order = order[np.lexsort((y[np.arange(n), widest[node]], node))]
    return (order, *(np.concatenate(z) for z in zip(*boxes)))


class EntryTree:
    """Binary tree over the entries of one codebook: boxes, children, and the entry of each leaf."""

    def __init__(self, book: np.ndarray):
        self.book, self.lo, self.hi, self.child, self.entry = book, [], [], [], []
        self._add(np.arange(len(book)))
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.child, self.entry = np.array(self.child), np.array(self.entry)

    def _add(self, members: np.ndarray) -> int:
        at, e = len(self.lo), self.book[members]
        self.lo.append(e.min(0))
        self.hi.append(e.max(0))
        self.child.append((-1, -1))
        self.entry.append(int(members[0]) if len(members) == 1 else -1)
        if len(members) > 1:
            by = members[np.argsort(e[:, np.argmax(e.max(0) - e.min(0))], kind="stable")]
            half = (len(by) + 1) // 2
            self.child[at] = (self._add(by[:half]), self._add(by[half:]))
        return at


def _runs(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))


def walk(order, lo, hi, x, tree: EntryTree, leaf: int = LEAF):
    """Nearest entry of every part: (whole nodes, their places, their entries, single rows, their entries).

    Whole nodes are numbered as in the tree's level-by-level list; places are [begin, end) in ``order``.
    """
    bounds = bounds_of(len(order), levels_of(len(order), leaf))
    book = tree.book
    norm = (book * book).sum(1)
    whole, begin, end, picked = [], [], [], []
    node, cand = np.zeros(1, np.int64), np.zeros(1, np.int64)
    base = 0
    for k, b in enumerate(bounds):
        deepest = k == len(bounds) - 1
        while True:
            # entry nodes go down one level, all the way at the deepest points
            inner = tree.entry[cand] < 0
            node = np.concatenate((node[~inner], np.repeat(node[inner], 2)))
            cand = np.concatenate((cand[~inner], tree.child[cand[inner]].ravel()))
            by = np.argsort(node, kind="stable")
            node, cand = node[by], cand[by]
            nl, nh, cl, ch = lo[base + node], hi[base + node], tree.lo[cand], tree.hi[cand]
            gap = np.maximum(0, np.maximum(cl - nh, nl - ch))
            least = (gap * gap).sum(1)
            span = np.maximum(nh - cl, ch - nl)
            most = (span * span).sum(1)
            first = _runs(node)
            limit = np.minimum.reduceat(most, first)
            keep = least <= np.repeat(limit, np.diff(np.append(first, len(node))))
            node, cand = node[keep], cand[keep]
            if not deepest or not (tree.entry[cand] < 0).any():
                break
        single = tree.entry[cand]
        if (single >= 0).all():
            # the entry nearest to the middle of a node's box against each other one: does one win all over the box?
            nl, nh = lo[base + node], hi[base + node]
            off = nl + nh - 2 * book[single]
            score = (off * off).sum(1)
            by = np.lexsort((single, score, node))
            node, single, cand, nl, nh = node[by], single[by], cand[by], nl[by], nh[by]
            first = _runs(node)
            size = np.diff(np.append(first, len(node)))
            best = np.repeat(single[first], size)
            way = book[single] - book[best]
            reach = 2 * np.maximum(nl * way, nh * way).sum(1)
            ahead = norm[single] - norm[best] - reach      # least of d(x, other) - d(x, best) over the box
            keep = (ahead < 0) | (ahead == 0) & (single < best) | (single == best)
            node, cand = node[keep], cand[keep]
        first = _runs(node)
        size = np.diff(np.append(first, len(node)))
        alone = first[(size == 1) & (tree.entry[cand[first]] >= 0)]
        whole.append(base + node[alone])
        begin.append(b[node[alone]])
        end.append(b[node[alone] + 1])
        picked.append(tree.entry[cand[alone]])
        rest = np.ones(len(node), bool)
        rest[alone] = False
        node, cand = node[rest], cand[rest]
        base += len(b) - 1
        if not len(node):
            break
        if not deepest:
            node, cand = np.concatenate((2 * node, 2 * node + 1)), np.concatenate((cand, cand))
    rows, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(node):
        # uncertain leaves: every part against its leaf's entries
        by = np.lexsort((tree.entry[cand], node))
        node, single = node[by], tree.entry[cand[by]]
        first = _runs(node)
        size = np.diff(np.append(first, len(node)))
        b = bounds[-1]
        leaves = node[first]
        per = b[leaves + 1] - b[leaves]
        total = np.cumsum(per) - per
        place = np.arange(int(per.sum())) + np.repeat(b[leaves] - total, per)
        rows = order[place]
        width, head = np.repeat(size, per), np.repeat(first, per)
        at = np.cumsum(width) - width
        e = single[np.arange(int(width.sum())) + np.repeat(head - at, width)]
        d = x[np.repeat(rows, width)] - book[e]
        found = np.minimum.reduceat((d * d).sum(1) * len(book) + e, at) % len(book)
    return np.concatenate(whole), np.concatenate(begin), np.concatenate(end), np.concatenate(picked), rows, found


def integers(col: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of a batch's vectors, padded with zeros to ``width``."""
    offs = col.offsets.to_numpy().astype(np.int64)
    flat = np.floor(col.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]].astype(np.float64) * SCALE).astype(np.int64)
    size = np.diff(offs)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)] = flat
    return out


def _parts(x: np.ndarray, part: int) -> np.ndarray:
    w = x.shape[1] // PARTS
    return np.ascontiguousarray(x[:, part * w:(part + 1) * w])


BLOCK = "vec_id array<{id}>, label array<{label}>, vectors binary, orders binary, lo binary, hi binary, sums binary"


def write_blocks(rows: DataFrame, width: int, leaf: int = LEAF) -> DataFrame:
    """One row per block of vectors: ids, labels, integers and the trees of all positions."""
    kinds = dict(rows.dtypes)
    most = max(1, BLOCK_BYTES // (8 * width))

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), most):
                part = batch.slice(a, most)
                x = integers(part.column("embedding"), width)
                trees = [build_tree(_parts(x, p), leaf) for p in range(PARTS)]
                packed = [np.concatenate([t[k].ravel() for t in trees]).astype(kind).tobytes()
                          for k, kind in enumerate(("<i4", "<i4", "<i4", "<i8"))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part.column(c)]))
                         for c in ("vec_id", "label")]
                yield pa.record_batch([*lists, *(pa.array([z], pa.binary()) for z in (x.astype("<i4").tobytes(), *packed))],
                                      names=["vec_id", "label", "vectors", "orders", "lo", "hi", "sums"])

    return written(rows.mapInArrow(run, BLOCK.format(id=kinds["vec_id"], label=kinds["label"])), "vector-trees")


def _open(batch: pa.RecordBatch, width: int):
    """(vectors, trees by position) of each block of a batch."""
    w = width // PARTS
    for k in range(len(batch)):
        get = lambda c, kind: np.frombuffer(batch.column(c)[k].as_py(), kind).astype(np.int64)
        x = get("vectors", "<i4").reshape(-1, width)
        boxes = [get(c, kind).reshape(PARTS, -1, w) for c, kind in (("lo", "<i4"), ("hi", "<i4"), ("sums", "<i8"))]
        yield k, x, [(o, *(z[p] for z in boxes)) for p, o in enumerate(get("orders", "<i4").reshape(PARTS, -1))]


def lloyd_sums(blocks: DataFrame, books: list[np.ndarray], width: int, leaf: int = LEAF) -> list[tuple]:
    """(part, entry, count, sums) of one assignment of all parts: whole nodes by their cached sums."""
    w, n_entries = width // PARTS, len(books[0])

    def run(batches):
        count = np.zeros((PARTS, n_entries), np.int64)
        total = np.zeros((PARTS, n_entries, w), np.int64)
        trees = [EntryTree(b) for b in books]
        for batch in batches:
            for _, x, parts in _open(batch, width):
                for p, (order, lo, hi, sums) in enumerate(parts):
                    xp = _parts(x, p)
                    whole, begin, end, entry, rows, found = walk(order, lo, hi, xp, trees[p], leaf)
                    np.add.at(count[p], entry, end - begin)
                    np.add.at(total[p], entry, sums[whole])
                    np.add.at(count[p], found, 1)
                    np.add.at(total[p], found, xp[rows])
        used = np.argwhere(count > 0)
        yield pa.record_batch([pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)),
                               pa.array(count[count > 0]), pa.array(total[count > 0].tolist(), pa.list_(pa.int64()))],
                              names=["part", "entry", "n", "sums"])

    rows = blocks.drop("vec_id", "label").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    at = rows.select("part", "entry", "n", F.posexplode("sums").alias("k", "s")).groupBy("part", "entry", "k").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    return [tuple(r) for r in at.collect()]      # PARTS * ENTRIES * part width rows


def train(blocks: DataFrame, first: list[list[int]], width: int, rounds: int = ROUNDS, leaf: int = LEAF) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds, from the vectors of ``first``."""
    start = np.array(first, np.int64)
    books = [_parts(start, p) for p in range(PARTS)]
    for _ in range(rounds):
        for part, entry, k, n, s in lloyd_sums(blocks, books, width, leaf):
            books[part][entry, k] = s // n
    return books


def assign(blocks: DataFrame, books: list[np.ndarray], width: int, id_type: str, label_type: str, leaf: int = LEAF) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    def run(batches):
        trees = [EntryTree(b) for b in books]
        for batch in batches:
            for k, x, parts in _open(batch, width):
                codes = np.zeros((len(x), PARTS), np.uint8)
                error = np.zeros(len(x), np.int64)
                for p, (order, lo, hi, _) in enumerate(parts):
                    xp = _parts(x, p)
                    whole, begin, end, entry, rows, found = walk(order, lo, hi, xp, trees[p], leaf)
                    size = end - begin
                    place = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
                    codes[order[place], p] = np.repeat(entry, size)
                    codes[rows, p] = found
                    d = xp - books[p][codes[:, p]]
                    error += (d * d).sum(1)
                text = codes.tobytes().hex()
                ids, labels = batch.column("vec_id"), batch.column("label")
                yield pa.record_batch([
                    ids.slice(k, 1).flatten(), labels.slice(k, 1).flatten(),
                    pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]), pa.array(error)],
                    names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, leaf: int = LEAF) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is two hex digits: 1 to 256 entries")
    rows = vectors.select("vec_id", "embedding", "label").where(
        "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    kinds = dict(rows.dtypes)
    longest, largest = rows.agg(F.max(F.size("embedding")), F.max(F.expr(
        "aggregate(embedding, double(0), (m, x) -> greatest(m, abs(double(x))))"))).first()
    if longest is None:
        schema = StructType().add(rows.schema["vec_id"]).add("code", StringType()).add("error", LongType()) \
            .add("label_error", LongType()).add("codebooks_sha256", StringType())
        return spark.createDataFrame([], schema)
    width = max(1, -(-longest // PARTS)) * PARTS
    bound = math.floor(largest * SCALE) + 1
    if bound >= 1 << 31 or 4 * bound * bound * width * entries >= 1 << 63:
        raise ValueError(f"components up to {largest}: their squared integer distances do not fit 64 bits")
    first = [[math.floor(SCALE * x) for x in r[0]] + [0] * (width - len(r[0]))
             for r in rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()]
    blocks = write_blocks(rows, width, leaf)
    books = train(blocks, first, width, rounds, leaf)
    numbers = ",".join(str(v) for b in books for v in b.ravel().tolist())
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    coded = written(assign(blocks, books, width, kinds["vec_id"], kinds["label"], leaf), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
