import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabloom.llm import minhash as m
from tabloom.llm.common import BATCH_BYTES, small_batches, table
from tabloom.llm.components import components
from tabloom.llm.textnp import Words, texts

import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = tuple(WORD.findall((text or "").translate(LOW)))
    return frozenset(w[i:i + k] for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([w] if w else [])


def brute(rows, k):
    """{index: (set size, smallest doc_id of the component)}; rows without shingles stand alone."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 80 * max(len(a), len(b)) <= 100 * min(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        comp = (min(ids) if ids else None) if sets[i] else d
        out.append((d, len(sets[i]), comp, d is not None and d == comp))
    return out


def result(df):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert by_id(result(m.near_duplicates(table(spark, sf, "documents"), 4))) == by_id(brute(rows, 4))


def cloud(rng, n, size, edits):
    """Near copies of one text that are not all within the threshold of each other, and chains."""
    base = [f"b{i}" for i in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    for _ in range(20):
        w = list(base)
        at = rng.randrange(size)
        w[at] = f"c{rng.randrange(10**6)}"
        base = w
        out.append(" ".join(base))
    return out


def test_hard_rows_and_wide_groups(make_docs, hard_rows, monkeypatch):
    rng = random.Random(2)
    rows = hard_rows + [(1000 + i, t) for i, t in enumerate(cloud(rng, 90, 150, 8) + ["same text here now ok"] * 60)]
    monkeypatch.setattr(m, "BLOCK", 16)     # many blocks in a bucket
    docs = make_docs(rows)
    assert by_id(result(m.near_duplicates(docs, 5))) == by_id(brute(rows, 5))
    left = m.deduplicate(docs)
    assert left.dtypes == docs.dtypes
    want = {d for d, n, c, kept in brute(rows, 5) if kept or d is None}
    got = [r.doc_id for r in left.collect()]
    assert set(got) == want and len(got) == len(want)


def test_ids_shared_by_different_texts(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{p}{rng.randrange(500)}" for _ in range(60)) for p in "abc")
    near = a.replace(a.split()[30], "other")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (2, b, "y"), (3, b, "z"), (4, c, "w"), (4, a, "v"), (None, c, "n"), (5, None, "e"),
            (5, "", "f"), (1, near, "t"), (6, c.upper(), "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__gone` string").withColumn("d", F.lit(1)).withColumn("key", F.lit("k"))
    out = m.deduplicate(docs)
    assert out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    # of a and near, both of document 1, the one with the smaller key stays
    assert got in (sorted([(1, t), (2, b), (4, c), (None, c), (5, None), (5, "")], key=str) for t in (a, near))


def test_whole_rows_stay_out_of_python(make_docs, hard_rows):
    """The kept rows are told by a digest of their text: only verdicts, no whole texts, come from Python."""
    out = m.deduplicate(make_docs(hard_rows))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    texts_ = spark.range(0, 8000, 1, 1).selectExpr("repeat('x', 2000) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with small_batches(spark):
        got = [r.n for r in texts_.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 8000 and max(got) * 2000 <= BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_empty_table(make_docs, hard_rows):
    docs = make_docs(hard_rows)
    assert m.near_duplicates(docs.limit(0)).count() == 0
    assert m.deduplicate(docs.where("doc_id in (4, 5)")).count() == 2


def test_components_of_chains_and_rings(spark):
    edges = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40)] + [(b"900", b"901"), (b"901", b"902"), (b"902", b"900"),
                                                                    (b"5", b"5"), (None, b"7")]
    df = spark.createDataFrame([(bytearray(a) if a else None, bytearray(b)) for a, b in edges], "u binary, v binary")
    got = {bytes(r.node): bytes(r.label) for r in components(df).collect()}
    assert got == {**{b"%03d" % i: b"000" for i in range(41)}, b"900": b"900", b"901": b"900", b"902": b"900"}
    assert components(df.limit(0)).count() == 0


def test_estimate_is_collision_corrected(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    pairs = []
    for share in (0.0, 0.5, 0.8, 1.0):
        k = int(2000 * share)
        other = np.concatenate((base[:k], rng.integers(0, 2**63, 2000 - k, dtype=np.uint64)))
        sig, _ = m.signatures(np.concatenate((np.sort(base), np.sort(other))), np.array([0, 2000, 4000]))
        pairs.append((share, [int(x) for x in sig[0].view(np.int64)], [int(x) for x in sig[1].view(np.int64)]))
    df = spark.createDataFrame(pairs, "share double, a array<long>, b array<long>")
    for r in df.selectExpr("share", f"{m.estimate_sql('a', 'b')} as est").collect():
        true = r.share / (2 - r.share)
        assert abs(r.est - true) < 0.16
        if r.share == 1.0:
            assert r.est == pytest.approx(1.0)


def test_shingles_of_short_rows():
    w = Words(*texts(pa.array(["a b c", "", "a", None, "a b c d e"])))
    s, at = w.shingles(4)
    assert np.diff(at).tolist() == [1, 0, 1, 0, 2] and len(set(s.tolist())) == 4
