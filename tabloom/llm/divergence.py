"""Source divergence audit on run-length encoded count columns.

Per language the kept vocabulary (terms in at least ``MIN_DOCS`` of its documents) is
reordered by the terms' vectors of counts, so that terms with equal counts stand
together.  Each source's column of counts over that order is then run-length encoded,
in blocks of the order; for two sources the run boundaries of a block are intersected
and the divergence term f of each common stretch is multiplied by its length.  Blocks
add up, so a language of any size is spread over many tasks.

p = 1 + floor(SCALE * (count + 1) / (N + V)), f(p, q) = floor((p - q)^2 / q), with N the
sum of the counts and V the number of kept terms.  All of it is integers: counts above
2^63 / SCALE are multiplied as Python integers (per distinct count of a block) or as
decimals; the sums fit 64 bits while V is below 8 * 10^9.

Counting is one pass: each task adds up its documents per (lang, source, term) and the
shuffle carries those sums, so a hot source or term is no hot key.  A term's vector holds
at most one cell per source of its language.  The result has one row per pair of sources;
a block's pairs are dealt in slices of ``SLICE`` sources.

Null text, lang and source are read as ''.  Repeated rows are documents of their own.  A
group whose texts hold no kept term has N = 0; a language without kept terms (V = 0)
gives pairs of value 0 and no terms.  A language with one source gives no pairs.  An
empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import written
from tabloom.llm.textnp import slices, texts

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
# distinct (group, term) entries a task holds before it hands them on
HELD = 1 << 18
# cells of count vectors in one block of the vocabulary
BLOCK_CELLS = 1 << 18
# sources of one slice of pairs
SLICE = 256
# bytes of one document counted at a time
PIECE = 4 << 20

# letters lower-cased, bytes outside ASCII kept, all others to spaces: what splits at spaces then are the terms
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes, limit: int = PIECE):
    """The text in runs of about ``limit`` bytes, cut at spaces only."""
    a = 0
    while len(text) - a > limit:
        b = text.find(b" ", a + limit)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:]


COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a row of term '' names each group."""
    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flush():
            cols = [[], [], [], [], []]
            for (lang, source), (n, seen) in held.items():
                k = len(n) + 1
                cols[0] += [lang] * k
                cols[1] += [source] * k
                cols[2] += [b"", *n]
                cols[3] += [0, *n.values()]
                cols[4] += [0, *(seen[t] for t in n)]
            held.clear()
            return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                    pa.array(cols[2], pa.binary()).view(pa.string()),
                                    pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                                   names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = texts(part.column("text"))
                raw, bounds = data.tobytes().translate(_FOLD), offs.tolist()
                groups = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
                for group, a, b in zip(groups, bounds[:-1], bounds[1:]):
                    n, docs_ = held.setdefault(group, (Counter(), Counter()))
                    was, seen = len(n), set()
                    for piece in pieces(raw[a:b]):
                        words = piece.split()
                        n.update(words)
                        seen.update(words)
                    docs_.update(seen)
                    size += len(n) - was + 1
                    if size > HELD:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


CLASSES = "lang string, cells array<struct<source string, n long>>, m long"
BLOCKS = ("lang string, width long, cols array<string>, runs array<int>, starts binary, counts binary")


def run_lengths(cells_at: np.ndarray, source: np.ndarray, n: np.ndarray, multiple: np.ndarray):
    """Run-length columns of one block: (sources, runs of each, run starts, run counts).

    ``cells_at``: class of each cell, ``source``: its column, ``n`` its count, ``multiple``
    the number of terms of each class.  Starts are places in the vocabulary order; a
    column begins with a run at place 0 and counts are 0 where a class has no cell.
    """
    place = np.concatenate(([0], np.cumsum(multiple)))
    order = np.lexsort((cells_at, source))
    c, s, v = cells_at[order], source[order], n[order]
    same = s[1:] == s[:-1]
    head = np.concatenate(([True], ~(same & (c[1:] == c[:-1] + 1) & (v[1:] == v[:-1]))))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(c)) - 1
    begin, stop = c[first], c[last] + 1
    col = s[first]
    # a run of zeros follows a run unless the column's next run begins there or the block ends
    follows = np.zeros(len(first), bool)
    follows[:-1] = (col[1:] == col[:-1]) & (begin[1:] == stop[:-1])
    zero = ~follows & (stop < len(multiple))
    # and one leads a column that does not begin at place 0
    lead = np.concatenate(([True], col[1:] != col[:-1])) & (begin > 0)
    cols = np.concatenate((col, col[zero], col[lead]))
    starts = np.concatenate((begin, stop[zero], np.zeros(int(lead.sum()), np.int64)))
    counts = np.concatenate((v[first], np.zeros(int(zero.sum()) + int(lead.sum()), np.int64)))
    order = np.lexsort((starts, cols))
    names, runs = np.unique(cols, return_counts=True)
    return names, runs, place[starts[order]], counts[order]


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of each count; once per distinct count, in Python integers."""
    distinct, which = np.unique(counts, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 1) // (n + v) for c in distinct], np.int64)[which]


def intersect(starts_a, p, starts_b, q, width: int) -> tuple[int, int]:
    """Sums over a block of f(p, q) and of f(q, p): one f per common stretch, times its length."""
    edges = np.union1d(starts_a, starts_b)
    a = p[np.searchsorted(starts_a, edges, side="right") - 1]
    b = q[np.searchsorted(starts_b, edges, side="right") - 1]
    length = np.diff(np.append(edges, width))
    square = (a - b) * (a - b)
    return int((square // b * length).sum()), int((square // a * length).sum())


def encode_blocks(classes: DataFrame, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Run-length columns of blocks of the reordered vocabulary: one row per block.

    The order is (lang, cells) within the ranges of Spark's exchange over the language, the
    number of cells and the first cell; blocks end with a task, a language, or ``block_cells`` cells.
    """
    def run(batches):
        lang, cells, sizes, multiple, held = None, [], [], [], 0

        def flush():
            size, mult = np.concatenate(sizes), np.concatenate(multiple)
            flat = pa.concat_arrays(cells)
            names = flat.field("source").dictionary_encode()
            cols, runs, starts, counts = run_lengths(np.repeat(np.arange(len(size)), size), names.indices.to_numpy(),
                                                     flat.field("n").to_numpy(), mult)
            return pa.record_batch([
                pa.array([lang]), pa.array([int(mult.sum())], pa.int64()),
                pa.array([names.dictionary.take(pa.array(cols)).to_pylist()], pa.list_(pa.string())),
                pa.array([runs.tolist()], pa.list_(pa.int32())),
                pa.array([starts.astype("<i8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())],
                names=["lang", "width", "cols", "runs", "starts", "counts"])

        for batch in batches:
            column = batch.column("cells")
            offs, flat = column.offsets.to_numpy(), column.values
            names, ms = batch.column("lang").to_pylist(), batch.column("m").to_numpy()
            a = 0
            while a < len(names):
                if cells and (names[a] != lang or held >= block_cells):
                    yield flush()
                    cells, sizes, multiple, held = [], [], [], 0
                lang = names[a]
                # as many classes of the same language as the block has room for, one at least
                b = bisect_right(names, lang, a)
                b = min(b, max(a + 1, int(np.searchsorted(offs, offs[a] + block_cells - held, side="right")) - 1))
                cells.append(flat.slice(offs[a], offs[b] - offs[a]))
                sizes.append(np.diff(offs[a:b + 1]))
                multiple.append(ms[a:b])
                held += int(offs[b] - offs[a])
                a = b
        if cells:
            yield flush()

    # ranges by a narrow key, so that the sample behind the bounds is small
    return classes.select("lang", "cells", "m").repartitionByRange("lang", F.size("cells"), F.col("cells")[0]) \
        .sortWithinPartitions("lang", "cells").mapInArrow(run, BLOCKS)


def pair_sums(blocks: DataFrame, stats: DataFrame, slice_: int = SLICE) -> DataFrame:
    """lang, source, item, value: the divergence of every ordered pair of sources of a language."""
    heads = stats.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all"), F.first("v").alias("v"))
    dealt = blocks.join(heads, "lang").withColumn("part", F.explode(F.sequence(
        F.lit(0), F.floor((F.size("all") - 1) / slice_).cast("int"))))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                names, total, v = [x["source"] for x in r["all"]], [x["n"] for x in r["all"]], r["v"]
                starts, counts = (np.frombuffer(r[c], "<i8") for c in ("starts", "counts"))
                end = np.cumsum(r["runs"])
                own = {c: (int(e - k), int(e)) for c, k, e in zip(r["cols"], r["runs"], end)}
                zero = np.zeros(1, np.int64)
                columns = []
                for name, n in zip(names, total):
                    a, b = own.get(name, (0, 0))
                    columns.append((starts[a:b], shares(counts[a:b], n, v)) if b > a else (zero, shares(zero, n, v)))
                lo = r["part"] * slice_
                for i in range(lo, min(lo + slice_, len(names))):
                    out = [intersect(*columns[i], *columns[j], r["width"]) for j in range(i + 1, len(names))]
                    if not out:
                        continue
                    here, there = zip(*out)
                    rest = names[i + 1:]
                    yield pa.record_batch([
                        pa.array([r["lang"]] * (2 * len(rest))), pa.array([names[i]] * len(rest) + rest),
                        pa.array(rest + [names[i]] * len(rest)), pa.array([*here, *there], pa.int64())],
                        names=["lang", "source", "item", "value"])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, F.xxhash64("starts"), "part") \
        .mapInArrow(run, "lang string, source string, item string, value long") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(count: str, n: str) -> F.Column:
    return F.expr(f"1 + cast({SCALE} * cast({count} + 1 as decimal(27,0)) as decimal(38,0)) div cast({n} + v as decimal(20,0))")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of every (lang, source)."""
    raw = written(term_counts(docs), "term-counts")
    groups = raw.where("term = ''").select("lang", "source")
    # one row per kept term: its counts by source
    vectors = written(
        raw.where("term <> ''").groupBy("lang", "term").agg(
            F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs).drop("docs"), "term-vectors")
    langs = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    cells = vectors.select("lang", "term", "total", F.explode("cells").alias("c")).select(
        "lang", "term", "total", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    stats = written(groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v"),
        F.coalesce("lang_n", F.lit(0)).cast("long").alias("lang_n")), "group-stats")

    classes = vectors.groupBy("lang", "cells").agg(F.count("*").alias("m"))
    blocks = written(encode_blocks(classes), "run-lengths")
    pairs = pair_sums(blocks, stats).unionByName(
        stats.where("v = 0").select("lang", "source").join(
            stats.where("v = 0").select("lang", F.col("source").alias("item")), "lang").where("source <> item")
        .select("lang", "source", "item", F.lit(0).cast("long").alias("value")))

    of = stats.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n")
    terms = cells.join(of, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share("n", "group_n").alias("p"), _share("total", "lang_n").alias("q")) \
        .where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows, part):
        return rows.withColumn("rank", F.row_number().over(order)).select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))
