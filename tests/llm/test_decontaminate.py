import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from tabloom.llm import decontaminate as d
from tabloom.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, size=10):
    out = []
    wins = [(i, {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))}) for i, w in
            ((i, words(t)) for i, t in items) if w]
    for doc, text in docs:
        w = words(text)
        hit, found = set(), []
        grams = {}
        for n in {len(x) for _, s in wins for x in s}:
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k:k + n]), []).append(k)
        for i, s in wins:
            at = [(k, len(x)) for x in s for k in grams.get(x, ())]
            if at:
                found.append("" if i is None else str(i))
                for k, n in at:
                    hit.update(range(k, k + n))
        found = sorted(set(found))          # item ids, as in the SQL: rows that share one count once
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def result(df):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def pairs(path, a, b):
    return [(r[a], r[b]) for r in pq.read_table(path).to_pylist()]


@pytest.mark.parametrize("part", [d.PART_BYTES, 1500])
def test_against_brute_force(spark, sf, part):
    docs, items = pairs(f"{sf}/documents.parquet", "doc_id", "text"), pairs(f"{sf}/benchmark.parquet", "item_id", "text")
    got = result(d.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), part_bytes=part))
    want = brute(docs, items)
    assert any(r[5] for r in want)
    assert by_id(got) == by_id(want)


def test_hard_rows_short_items_and_clashing_columns(spark, make_docs, hard_rows):
    items = [(1, "one TWO"), (2, "x"), (3, None), (4, "..."), (5, " ".join(hard_rows[2][1].split()[5:30])),
             (5, " ".join(hard_rows[2][1].split()[5:30])), (None, "línea única"), (7, hard_rows[2][1][:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(hard_rows)
    assert by_id(result(d.contamination(docs, bench))) == by_id(brute(hard_rows, items))
    clean = d.decontaminate(docs, bench)
    assert clean.dtypes == docs.dtypes
    want = [r for r in brute(hard_rows, items) if not r[5]]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in want)
    assert d.contamination(docs.limit(0), bench).count() == 0
    assert not any(r[5] for r in result(d.contamination(docs, bench.limit(0))))


def test_search_equals_naive_search():
    rng = random.Random(4)
    for _ in range(300):
        text = bytes(rng.choice(b"ab ") for _ in range(80))
        pats = list({bytes(rng.choice(b"ab ") for _ in range(rng.randint(2, 9))) for _ in range(6)})
        want = sorted((i, p) for p in pats for i in range(len(text)) if text.startswith(p, i))
        assert sorted(d.WuManber(pats).search(text)) == want
