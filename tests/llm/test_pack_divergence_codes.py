import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from tabloom.llm import divergence, pack, vector_codes  # noqa: E402
from tabloom.llm.common import table  # noqa: E402

WORDS = P.path("word_bpe_49k.json")
BITS = ["a", "bc", "'s", "'re", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "　", "́", "é", "é",
        "İ", "Σ", "ΑΣ", "中文", "\U0001f600", "1", "23", "²", "<|endoftext|>", "<|startoftext|>", "<|END", "\x00", "!?", "ß",
        "ﬁ", "​", "가", "가", "Ω"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORDS)


# ---------------------------------------------------------------- op11

def test_words_encode_as_whole_texts(tokenizer):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None, "", "x" * 5000]
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    with open(WORDS, "rb") as f:
        raw = f.read()
    for kept in (pack.KEPT, 50):        # the second forgets its words all the time
        encoder = pack.WordIds(raw, kept)
        assert encoder.by_word
        for a in range(0, len(texts), 500):
            ids, count = encoder.rows(pa.array(texts[a:a + 500], pa.string()))
            assert count.tolist() == [len(w) for w in want[a:a + 500]]
            assert ids.tolist() == [i for w in want[a:a + 500] for i in w]


def test_other_tokenizers_go_to_the_library_whole():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        encoder = pack.WordIds(f.read())
    assert not encoder.by_word
    texts = ["two  words\n", "", "<|endoftext|> x"]
    ids, count = encoder.rows(pa.array(texts))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_binary_pieces():
    row, length = pack.binary_pieces(np.array([1, 0, 13, 16, 37]), 16)
    assert row.tolist() == [0, 2, 2, 2, 3, 4, 4, 4, 4]
    assert length.tolist() == [1, 8, 4, 1, 16, 16, 16, 4, 1]
    with pytest.raises(ValueError):
        pack.pack(None, WORDS, max_len=100)


def check_packed(rows, got, tokenizer, max_len):
    """Every document's ids lie in power-of-two pieces that tile it, each alone in its sequence."""
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        at, out = 0, []
        while at < len(ids):
            n = min(max_len, 1 << (len(ids) - at).bit_length() - 1)
            out.append((at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids)))
            at += n
        want.update((i, *p) for p in out)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} <= {0}


def test_pack_hard_rows(make_docs, hard_rows, tokenizer):
    for max_len in (2048, 16):
        got = pack.digests(pack.pack(make_docs(hard_rows), WORDS, max_len=max_len)).collect()
        check_packed(hard_rows, got, tokenizer, max_len)
    out = pack.pack(make_docs(hard_rows), WORDS)
    assert out.where("length <> 1 << bucket or length(ids) <> 4 * length").count() == 0
    assert pack.digests(pack.pack(make_docs([]), WORDS)).count() == 0


def test_pack_table(spark, sf, tokenizer):
    docs = table(spark, sf, "documents")
    got = pack.digests(pack.pack(docs, WORDS)).collect()
    check_packed([(r.doc_id, r.text) for r in docs.collect()], got, tokenizer, 2048)


# ---------------------------------------------------------------- op12

def brute_divergence(rows, min_docs=3, top=200):
    """rows of (lang, source, text)."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w)
                 for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)
        whole = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})

        def share(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // (size + len(kept)) for t in kept}

        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, cut in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:cut])]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["É", "straße", "中文", "Zz", "zZ"]
    rows = []
    for k in range(300):
        lang = rng.choice(["en", "fr", None, "xx"])
        source = "hot" if rng.random() < .4 else rng.choice(["a", "b", "é", None])
        rows.append((lang, source, " ".join(rng.choice(vocabulary[:rng.randrange(1, 31)]) for _ in range(rng.randrange(30)))))
    rows += rows[:5] + [("en", "empty", None), ("en", "blank", " 12 \n"), ("none", "a", "one two"), ("none", "b", None),
                        ("only", "a", "x x x"), ("only", "a", "x y"), ("only", "a", "x")]
    docs = spark.createDataFrame([(k, *r, 1, "t") for k, r in enumerate(rows)],
                                 "doc_id long, lang string, source string, text string, n long, term string").repartition(5)
    want = brute_divergence(rows)
    assert as_rows(divergence.divergence(docs)) == want
    # "only" has one source, whose shares are the language's own: no pair and no term above
    assert {r[0] for r in want} == {"en", "fr", "", "xx", "none"} and ("none", "a", "pair", "b", 0, 1) in want
    # small blocks, slices, counts handed on early, and texts counted in pieces
    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr(divergence.pieces, "__defaults__", (20,))
    monkeypatch.setattr(divergence.encode_blocks, "__defaults__", (5,))
    monkeypatch.setattr(divergence.pair_sums, "__defaults__", (2,))
    assert as_rows(divergence.divergence(docs)) == want
    assert as_rows(divergence.divergence(docs, top_terms=2)) == brute_divergence(rows, top=2)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_run_lengths_give_back_the_counts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        classes, sources = int(rng.integers(1, 12)), int(rng.integers(1, 6))
        dense = rng.integers(0, 3, (classes, sources))
        dense[dense.sum(1) == 0, 0] = 1
        multiple = rng.integers(1, 4, classes)
        at, s = np.nonzero(dense)
        names, runs, starts, counts = divergence.run_lengths(at, s, dense[at, s], multiple)
        want = np.repeat(dense, multiple, axis=0)
        end = np.cumsum(runs)
        for name, e, k in zip(names, end, runs):
            a, c = starts[e - k:e], counts[e - k:e]
            assert a[0] == 0 and (np.diff(a) > 0).all() and (np.diff(c) != 0).all()
            assert (np.repeat(c, np.diff(np.append(a, len(want)))) == want[:, name]).all()
        assert set(names) == set(np.flatnonzero(dense.sum(0)))


def test_shares_are_exact_beyond_64_bits():
    big = 10**13
    assert divergence.shares(np.array([big, 0, big]), 2 * big, 5).tolist() == [
        1 + 10**9 * (c + 1) // (2 * big + 5) for c in (big, 0, big)]


# ---------------------------------------------------------------- op13

def brute_codes(rows, entries=16, rounds=6):
    """rows of (vec_id, vector, label), kept ones only, vectors of equal length divisible by 8."""
    x = np.array([[int(np.floor(4096 * np.float64(v))) for v in r[1]] for r in rows], dtype=object).reshape(len(rows), 8, -1)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[list(x[i, p]) for i in first] for p in range(8)]

    def nearest(p):
        out = []
        for v in x[:, p]:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(8):
            at = [k for k, _ in nearest(p)]
            for k in range(len(books[p])):
                own = [x[i, p] for i in range(len(rows)) if at[i] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = [nearest(p) for p in range(8)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    error = [sum(f[i][1] for f in found) for i in range(len(rows))]
    label = Counter()
    for r, e in zip(rows, error):
        label[r[2]] += e
    return Counter((r[0], "".join(f"{f[i][0]:02x}" for f in found), error[i], label[r[2]], digest) for i, r in enumerate(rows))


DDL = "vec_id long, embedding array<float>, label int, n long, of int, error string"


def as_codes(df):
    return Counter(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_vector_codes_against_brute_force(spark):
    rng = np.random.default_rng(6)
    good = []
    for k in range(150):
        v = rng.normal(size=16).astype(np.float32) if rng.random() < .6 else rng.integers(-1, 2, 16).astype(np.float32)
        good.append((int(k * 37 % 150), v.tolist(), None if rng.random() < .2 else int(rng.integers(3))))
    hot = good[3][1]
    good += [(1000 + k, hot, 0) for k in range(80)] + [(5, good[9][1], 1), (5, good[9][1], 1), (None, hot, None)]
    bad = [(2000, None, 0), (-5, [1.0] * 15 + [None], 0), (-6, [1.0] * 15 + [float("nan")], 0), (-7, [float("inf")] * 16, 1)]
    rows = spark.createDataFrame([(*r, 1, 2, "e") for r in good + bad], DDL).repartition(4)
    want = brute_codes(good)
    for leaf in (vector_codes.LEAF, 1, 4):
        assert as_codes(vector_codes.compress(rows, leaf=leaf)) == want
    few = spark.createDataFrame([(*r, 1, 2, "e") for r in good[:5]], DDL)
    assert as_codes(vector_codes.compress(few)) == brute_codes(good[:5])


def test_vector_codes_edges(spark):
    out = vector_codes.compress(spark.createDataFrame([], DDL))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 0, 1, 2, "e")], DDL)).count() == 0
    # shorter vectors are padded with zeros; an empty one is all zeros
    ragged = spark.createDataFrame([(1, [1.0] * 9, 0, 1, 2, "e"), (2, [1.0], 0, 1, 2, "e"), (3, [], 0, 1, 2, "e")], DDL)
    padded = [(1, [1.0] * 9 + [0.0] * 7, 0), (2, [1.0] + [0.0] * 15, 0), (3, [0.0] * 16, 0)]
    assert as_codes(vector_codes.compress(ragged)) == brute_codes(padded)
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 0, 1, 2, "e")], DDL))


def test_walk_assigns_whole_nodes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-10**5, 10**5, (16, 4))
    x = (centres[rng.integers(0, 16, 5000)] + rng.integers(-50, 50, (5000, 4))).astype(np.int64)
    tree = vector_codes.build_tree(x)
    whole, begin, end, entry, rows, found = vector_codes.walk(*tree[:3], x, vector_codes.EntryTree(centres))
    assert (end - begin).sum() > 4000       # clustered parts: most are assigned by node, not one by one
    got = np.full(len(x), -1)
    for a, b, e, w in zip(begin, end, entry, whole):
        got[tree[0][a:b]] = e
        assert (tree[3][w] == x[tree[0][a:b]].sum(0)).all()
    got[rows] = found
    assert (got == ((x[:, None] - centres) ** 2).sum(2).argmin(1)).all()
