"""Near-duplicate documents by b-bit MinHash.

Per distinct text (exact copies are one node): ``BANDS * ROWS`` minima over
word-shingle hashes; band hashes of the full minima generate candidates; the
low 4 bits of each minimum are packed into ten 64-bit words and compared by bit
counts, and the collision-corrected estimate drops hopeless candidates before
the exact Jaccard test on full shingle sets.

No bucket emits its pairs.  First each text is tried against one hub, the smallest key of
the bucket whose hub has the nearest signature, then against its other hubs that are not yet
in its component (at most one candidate per member and band).  Buckets whose members are
then in one component are done: more links there cannot change a component.  The members
of the other buckets meet in blocks of at most ``BLOCK`` members, in two passes: signatures
alone tell which members have a near one in another component (a pair counts in the first
of its common bands only), and only those are joined with their shingle sets and compared
exactly, inside ``applyInPandas`` groups that emit nothing but the links found.  A bucket of
any size is thus split into blocks and nothing is capped.

At similarity 0.8 a pair meets in no band with probability (1-0.8^5)^32 =
3e-6, and the estimate falls below the cut (5 standard deviations) with 3e-7.

Null, empty and blank texts have no shingles and are linked with nothing:
their component is their own doc_id.  Repeated rows share a component and give
repeated result rows; a null doc_id is never a component's name if another id
is there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import scratch_tables, small_batches, written
from tabloom.llm.components import components
from tabloom.llm.textnp import LOWER, Words, mix, seeds, segment_hash, slices, texts

SHINGLE = 5
THRESHOLD_PCT = 80
BANDS = 32
ROWS = 5
LANE_BITS = 4
BLOCK = 1024
# five standard deviations of the estimate below the threshold of 0.8
ESTIMATE_CUT = 0.62

_U = np.uint64
_K = BANDS * ROWS
_PACKED = _K * LANE_BITS // 64


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row and their index range."""
    s, at = words.shingles(k)
    out, ends = [], [0]
    for a, b in zip(at[:-1], at[1:]):
        v = np.sort(s[a:b])
        if b - a > 1:
            v = v[np.concatenate(([True], v[1:] != v[:-1]))]
        out.append(v)
        ends.append(ends[-1] + len(v))
    return (np.concatenate(out) if out else s), np.array(ends)


def text_keys(words: Words) -> list[bytes | None]:
    """128-bit hash of each row's word sequence; None without words."""
    has = np.flatnonzero(words.count > 0)
    first = words.row[:-1][has]
    key = np.empty((len(has), 2), _U)
    key[:, 0] = segment_hash(words.hash, first, 3)
    key[:, 1] = segment_hash(words.hash, first, 5)
    out: list[bytes | None] = [None] * len(words.count)
    for i, k in zip(has.tolist(), key):
        out[i] = k.tobytes()
    return out


def signatures(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, band hashes) of non-empty sets laid end to end."""
    low = (s >> _U(32)).astype(np.uint32)
    mul, add = seeds(_K, 21).astype(np.uint32) | np.uint32(1), seeds(_K, 22).astype(np.uint32)
    minima = np.empty((len(at) - 1, _K), np.uint32)
    for k in range(_K):
        minima[:, k] = np.minimum.reduceat(low * mul[k] + add[k], at[:-1])
    mixed = mix(minima.astype(_U) + seeds(_K, 23))
    lanes = mixed & _U((1 << LANE_BITS) - 1)
    per = 64 // LANE_BITS
    shift = (np.arange(_K, dtype=_U) % _U(per)) * _U(LANE_BITS)
    packed = (lanes << shift).reshape(len(minima), _PACKED, per).sum(axis=2, dtype=_U)
    bands = mix(mixed.reshape(len(minima), BANDS, ROWS).dot(seeds(ROWS, 24)) + np.arange(BANDS, dtype=_U))
    return packed, bands


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = texts(part.column("text"))
                w = Words(data, offs, LOWER)
                s, at = shingle_sets(w, shingle)
                n = np.diff(at)
                has = n > 0
                m = int(has.sum())
                packed, bands = signatures(s, np.append(at[:-1][has], at[-1])) if m else (
                    np.zeros((0, _PACKED), _U), np.zeros((0, BANDS), _U))
                carried = [c for c in part.schema.names if c != "text"]
                yield pa.record_batch([
                    *(part.column(c) for c in carried), pa.array(n.astype(np.int64)), pa.array(text_keys(w), pa.binary()),
                    _lists(packed, has, _PACKED), _lists(bands, has, BANDS)],
                    names=[*carried, "n_shingles", "key", "sig", "bands"])
    return run


def _lists(rows: np.ndarray, has: np.ndarray, width: int) -> pa.Array:
    offs = np.concatenate(([0], np.cumsum(has * width))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(rows.reshape(-1).view(np.int64)),
                                    mask=pa.array(~has))


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = texts(part.column("text"))
                w = Words(data, offs, LOWER)
                s, at = shingle_sets(w, shingle)
                yield pa.record_batch([
                    pa.array(text_keys(w), pa.binary()),
                    pa.array([s[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["key", "shingles"])
    return run


def similar(a: bytes, b: bytes, pct: int) -> bool:
    """100 * intersection >= pct * union of two sorted distinct hash arrays."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if 100 * min(len(x), len(y)) < pct * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= pct * (len(both) - inter)


def _verify(pct: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist()
            ok = pa.array([similar(x, y, pct) for x, y in zip(a, b)], pa.bool_())
            yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(ok)
    return run


def estimate_sql(a: str, b: str) -> str:
    """Collision-corrected similarity of two packed signatures, by bit counts of differing lanes."""
    diff = []
    for i in range(_PACKED):
        x = f"({a}[{i}] ^ {b}[{i}])"
        y = f"({x} | shiftrightunsigned({x}, 2))"
        diff.append(f"bit_count(({y} | shiftrightunsigned({y}, 1)) & 1229782938247303441L)")
    c = 2.0 ** -LANE_BITS
    return f"((({_K} - ({' + '.join(diff)})) / {_K}D) - {c}D) / {1 - c}D"


def _lane_diff(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    x |= x >> _U(2)
    x |= x >> _U(1)
    return np.bitwise_count(x & _U(0x1111111111111111)).sum(axis=-1)


def _most_lanes() -> int:
    """Differing lanes at the estimate cut."""
    return int(_K * (1 - (ESTIMATE_CUT * (1 - 2.0 ** -LANE_BITS) + 2.0 ** -LANE_BITS)))


def _near_rows(band, x, y, block, label, sig, bands) -> np.ndarray:
    """Which rows of groups laid end to end have a near signature across blocks and components.

    Groups are runs of equal (band, x, y); a pair counts in the first of its common bands only.
    """
    n = len(band)
    most = _most_lanes()
    wanted = np.zeros(n, bool)
    edge = np.concatenate(([True], (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, n))

    def meet(i, j):
        """Rows i and j (arrays of equal length): mark those that are near."""
        keep = (label[i] != label[j]) & ((x[i] == y[i]) | (block[i] != block[j]))
        i, j = i[keep], j[keep]
        keep = _lane_diff(sig[i], sig[j]) <= most
        i, j = i[keep], j[keep]
        if len(i):
            first = (bands[i] == bands[j]).argmax(axis=1)
            keep = bands[i, first] == band[i]
            wanted[i[keep]] = True
            wanted[j[keep]] = True

    # the many groups of a few rows together, pair by pair; larger ones row by row
    for small in range(2, 9):
        at = start[size == small]
        for a in range(small):
            for b in range(a + 1, small):
                meet(at + a, at + b)
    for a, k in zip(start[size > 8].tolist(), size[size > 8].tolist()):
        for i in range(a, a + k - 1):
            rest = np.arange(i + 1, a + k)
            meet(np.full(len(rest), i), rest)
    return wanted


def _near_members(batches):
    """Rows of :data:`NEAR` of the members that :func:`_near_rows` marks; input sorted by band, x, y."""
    def handle(t: pa.Table):
        t = t.combine_chunks()
        num = {c: t.column(c).to_numpy() for c in ("band", "x", "y", "block")}
        labels = t.column("label").combine_chunks()
        code = labels.dictionary_encode()
        code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
        sig, bands = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(len(t), -1) for c in ("sig", "bands"))
        wanted = _near_rows(num["band"], num["x"], num["y"], num["block"], np.asarray(code.indices), sig.view(_U), bands)
        return t.filter(pa.array(wanted)).drop_columns(["bands"]).combine_chunks().to_batches()

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, t]) if held is not None else t
        k = len(held)
        if not k:
            continue
        # the last group may go on in the next batch
        keys = [held.column(c).to_numpy() for c in ("band", "x", "y")]
        whole = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]) | (keys[2] != keys[2][-1]))
        a = int(whole[-1]) + 1 if len(whole) else 0
        if a:
            yield from handle(held.slice(0, a))
            held = held.slice(a)
    if held is not None and len(held):
        yield from handle(held)


NEAR = "band long, x int, y int, block int, key binary, label binary, sig array<long>"


def _block_links(pct: int):
    """Links between the two blocks of a group (or within one), across components only."""
    most = _most_lanes()

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        x, y = key[1], key[2]
        g = g.sort_values("key", ignore_index=True)
        sig = np.array(g["sig"].tolist(), dtype=np.int64).view(_U)
        block, keys, sets = g["block"].to_numpy(), g["key"].tolist(), g["shingles"].tolist()
        _, label = np.unique(np.array([v.hex() for v in g["label"]]), return_inverse=True)
        parent = list(range(int(label.max()) + 1))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for i in range(len(g)):
            rest = np.arange(i + 1, len(g))
            if x != y:
                rest = rest[block[rest] != block[i]]
            rest = rest[label[rest] != label[i]]
            if not len(rest):
                continue
            d = _lane_diff(sig[rest], sig[i])
            near = d <= most
            for j in rest[near][np.argsort(d[near], kind="stable")].tolist():
                p, q = root(int(label[i])), root(int(label[j]))
                if p != q and similar(sets[i], sets[j], pct):
                    parent[p] = q
                    out.append((keys[i], keys[j]))
        return pd.DataFrame(out, columns=["u", "v"])
    return run


def _labelled(links: DataFrame, n: int) -> DataFrame:
    return written(components(links), "labels", n)


def _verified(pairs: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar."""
    with small_batches(pairs.sparkSession):
        return written(
            pairs.select("u", "v").join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("a_set")), "u")
            .join(sets.select(F.col("key").alias("v"), F.col("shingles").alias("b_set")), "v")
            .mapInArrow(_verify(threshold_pct), "u binary, v binary"), "links")


def _classes(docs: DataFrame, shingle: int, threshold_pct: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, key) of every row, and per text key its component's smallest doc_id and that document's key.

    A column ``digest`` of ``docs`` stays beside the doc_id.
    """
    if threshold_pct < 80:
        raise ValueError("the bands find pairs at a similarity of 0.8 or more")
    carried = ["doc_id", *(c for c in docs.columns if c == "digest")]
    types = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in carried)
    with small_batches(docs.sparkSession):
        rows = written(docs.select(*carried, "text").mapInArrow(
            _fingerprints(shingle), f"{types}, n_shingles long, key binary, sig array<long>, bands array<long>"),
            "fingerprints")
    reps = rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    n = rows.count()
    reps = written(reps, "texts", n)

    slots = reps.select("key", F.explode("bands").alias("band"))
    buckets = slots.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("size")).where("size > 1")
    member = written(slots.join(buckets, "band"), "buckets")

    # the star of each bucket, estimated on packed signatures
    star = member.where(F.col("key") != F.col("hub")).select("key", "hub").distinct()
    sig = reps.select("key", "sig")
    pairs = (star.join(sig, "key").join(sig.select(F.col("key").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
             .select(F.col("key").alias("u"), F.col("hub").alias("v"), F.expr(estimate_sql("sig", "hub_sig")).alias("est"))
             .where(F.col("est") >= ESTIMATE_CUT))
    pairs = written(pairs, "star-pairs", n)

    wanted = member.select("key").distinct()
    ids = wanted.join(reps.select("key", "rep"), "key").select("rep").distinct()
    sets = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi") \
        .select("text").mapInArrow(_sets(shingle), "key binary, shingles binary")
    with small_batches(docs.sparkSession):
        sets = written(sets.where(F.col("key").isNotNull()).dropDuplicates(["key"]), "sets")

    # one hub per text first; of the other pairs those whose ends are still apart
    links = _verified(pairs.groupBy("u").agg(F.max_by("v", F.struct("est", "v")).alias("v")), sets, threshold_pct)
    label = _labelled(links, n)
    ends = pairs.join(label.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u", "left") \
        .join(label.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v", "left")
    apart = ends.where(F.coalesce("lu", "u") != F.coalesce("lv", "v"))
    links = links.union(_verified(apart, sets, threshold_pct))
    label = _labelled(links, n)

    # buckets that still hold several components: compare across them, in blocks
    named = member.join(label, F.col("key") == F.col("node"), "left").select(
        "band", "key", "size", F.coalesce("label", "key").alias("label"))
    open_ = named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")) \
        .where(F.col("lo") != F.col("hi")).select("band")
    rest = named.join(open_, "band", "left_semi")
    n_blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("key"), n_blocks).cast("int")) \
        .join(reps.select("key", "sig", "bands"), "key") \
        .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1))) \
        .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rest.select("band", "x", "y", "block", "key", "label", "sig", "bands").repartition(parts, "band", "x", "y") \
        .sortWithinPartitions("band", "x", "y").mapInArrow(_near_members, NEAR)
    second = written(
        near.join(sets, "key").repartition(parts, "band", "x", "y").groupBy("band", "x", "y").applyInPandas(_block_links(threshold_pct), "u binary, v binary").distinct(),
        "more-links", n)

    label = components(links.union(second))
    named = reps.select("key", "rep").join(label, F.col("key") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("label", "key").alias("label"))
    # the smallest doc_id of a component, a null one only where there is no other, and the smallest key that has it
    smallest = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("m")) \
        .select("label", F.col("m.rep").alias("component"), F.col("m.key").alias("first"))
    return rows.select(*carried, "n_shingles", "key"), named.join(smallest, "label").select("key", "component", "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    ``threshold_pct`` of 80 or more: bands, lanes and the cut are laid out for it.
    """
    rows, by_text = _classes(docs, shingle, threshold_pct)
    return rows.join(by_text.select("key", "component"), "key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _digest(text):
    """Names a text without Python; equal texts have equal keys."""
    return F.unhex(F.sha2(text, 256))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """One document of each group with all its columns; documents without words all stay.

    Of a group stays the document of its smallest doc_id (of several texts with that doc_id the one
    of the smallest key); a doc_id may stand for several texts, the verdict is on the row.  Rows equal
    in doc_id and words become one; rows without a doc_id stay.
    """
    with scratch_tables(docs.sparkSession):
        rows, by_text = _classes(docs.select("doc_id", "text", _digest("text").alias("digest")), shingle, threshold_pct)
        count = rows.count()
        rows = rows.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id", "key", "digest") \
            .agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(Window.partitionBy("doc_id", "key")))
        verdict = written(rows.join(by_text, "key").select(
            F.col("doc_id").alias("id"), "digest", F.col("key").alias("of"), "n",
            ((F.col("key") == F.col("first")) & (F.col("doc_id") == F.col("component"))).alias("stays")).where("n > 1 or not stays"), "verdicts", count, keep=True)
    # the whole rows meet their verdicts by doc_id and digest, so no text goes through Python again
    kept = docs.select(F.struct("*").alias("d"), _digest("text").alias("t"))
    here = (F.col("t") == F.col("digest")) & (F.col("d.doc_id") == F.col("id"))
    out = kept.join(verdict.where("not stays"), here, "left_anti")
    again = verdict.where("stays")
    if again.limit(1).count():
        out = out.join(again, here, "left_anti").select("d").unionByName(
            out.join(again, here).dropDuplicates(["id", "of"]).select("d"))
    return out.select(*(F.col("d").getField(c).alias(c) for c in docs.columns))
