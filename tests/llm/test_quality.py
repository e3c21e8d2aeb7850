import collections
import random
import re

import pyarrow.parquet as pq
import pytest

from tabloom.llm import quality as q
from tabloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    c = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_measures_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = q.quality(table(spark, sf, "documents")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in BASE) == brute(texts[r["doc_id"]])


def test_hard_rows(make_docs, hard_rows):
    docs = make_docs(hard_rows)
    got = q.quality(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words) for r in got) == sorted(
        (str(i), brute(t)[0], brute(t)[4]) for i, t in hard_rows)
    kept = q.filter_quality(docs)
    assert kept.dtypes == docs.dtypes
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert q.quality(docs.limit(0)).count() == 0
    assert q.filter_quality(docs.limit(0)).count() == 0


def boilerplate_rows():
    rng = random.Random(1)

    def word(head):      # digits are all alike to the line rules
        return head + "".join(rng.choice("bcdfghjklm") for _ in range(7))

    line = " ".join(["all rights reserved by the owners of this site in 2020", *(f"term{chr(97 + i)}" for i in range(25)),
                     *(f"rule{chr(97 + i)}" for i in range(26)), "the end of it"])
    rows = [(i, line.strip() + "\n" + " ".join(word("v") for _ in range(60))) for i in range(30)]
    # almost nothing but the shared line: depleted
    rows += [(100 + i, line.strip().replace("2020", "1999").upper() + "\n" + word("q")) for i in range(3)]
    # exact copies and near copies of one clean text: left alone
    clean = [" ".join(word("c") for _ in range(20)) for _ in range(8)]
    rows += [(200 + i, "\n".join(clean)) for i in range(40)]
    rows += [(300 + i, "\n".join([*clean[:6], clean[6] + " " + word("n"), clean[7]])) for i in range(40)]
    return rows, line.strip()


@pytest.mark.parametrize("bound", [10, 0])
def test_frequent_lines_are_removed_and_depleted_documents_rejected(make_docs, bound):
    rows, line = boilerplate_rows()
    docs = make_docs(rows)
    got = {r.doc_id: r for r in q.quality(docs, max_docs=20, broadcast_lines=bound).collect()}
    assert all(got[i].kept and got[i].removed_words == 66 for i in range(30))
    assert not any(got[100 + i].kept for i in range(3))
    assert all(got[i].kept and not got[i].removed_words for i in [*range(200, 240), *range(300, 340)])
    text = {r.doc_id: r for r in q.filter_quality(docs, max_docs=20, broadcast_lines=bound).collect()}
    assert set(text) == {i for i, r in got.items() if r.kept}
    original = dict(rows)
    assert all(text[i].text == original[i].split("\n")[1] and text[i].n_chars == len(text[i].text) for i in range(30))
    assert all(text[i].text == original[i] for i in range(200, 240))


def test_hosts_are_counted_apart(make_docs):
    rows, _ = boilerplate_rows()
    docs = make_docs([(i, t, f"host{i % 3}") for i, t in rows])
    assert all(r.removed_words == 0 for r in q.quality(docs, max_docs=20).collect())


def own_words(rng, n):
    return " ".join("".join(rng.choice("bcdfghjklm") for _ in range(8)) for _ in range(n))


@pytest.mark.parametrize("bound", [100, 0])
def test_near_copies_count_as_one_document(make_docs, bound):
    rng = random.Random(9)
    licence = "this text may be copied under the licence of the site"
    body = [own_words(rng, 30) for _ in range(6)]

    def copy(b):
        return "\n".join([licence, *b[:5], b[5] + " " + own_words(rng, 1)])

    # 60 unrelated holders and 90 near copies of one text, on another host two groups of near copies only
    rows = [(i, f"{licence}\n{own_words(rng, 60)}", "a") for i in range(60)]
    rows += [(100 + i, copy(body), "a") for i in range(90)]
    other = [own_words(rng, 30) for _ in range(6)]
    rows += [(200 + i, copy(body if i % 2 else other), "b") for i in range(80)]
    got = {r.doc_id: r for r in q.quality(make_docs(rows), max_docs=20, broadcast_lines=bound).collect()}
    assert {got[i].removed_words for i, _, s in rows if s == "a"} == {11}
    assert {got[i].removed_words for i, _, s in rows if s == "b"} == {0}
    assert all(r.kept for r in got.values())


def test_templates_of_several_lines_are_removed(make_docs):
    rng = random.Random(10)
    rows = []
    for h in range(6):
        template = [own_words(rng, 11) for _ in range(4)]
        rows += [(100 * h + i, "\n".join([*template[:2], own_words(rng, 20), *template[2:]]), f"h{h}") for i in range(60)]
    got = q.quality(make_docs(rows), max_docs=20).collect()
    assert {r.removed_words for r in got} == {44}
