import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")

from tabloom.llm import bpe, repair  # noqa: E402
from tabloom.llm.common import table  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
BITS = ["a", "bc", "'s", "'re", "'ll", "'l", " ", "  ", "\n", "\n\n", "\t", "1", "23", "!", "?!", "é", "ß", "ɏ", "ɐ", "中",
        "'", " '", "\r\n", "x" * 30, " the", "×", "²", "\x1c", "\xa0", "\x00", "<|endoftext|>"]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(bpe.read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(JSON)


def noise(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def test_stitched_pieces_encode_as_the_whole(enc):
    import regex
    rule, rng, pieces = regex.compile(P.PATTERN), random.Random(1), 0
    texts = [noise(rng, rng.randrange(120)) for _ in range(400)]
    texts += [" ".join(f"word{rng.randrange(99)}{rng.choice(['', '.', chr(10)])}" for _ in range(300)) for _ in range(10)]
    for t in texts:
        size, overlap = rng.choice([(5, 4), (16, 8), (40, 16), (200, 40)])
        parts = [(s, c, bpe.boundaries(rule, c, s)) for s, c in bpe.chunks(t, size, overlap)]
        got = bpe.stitch(parts, rule)
        pieces += len(got)
        assert "".join(got) == t
        assert [i for x in got for i in bpe.encode(enc, x).tolist()] == enc.encode_ordinary(t)
    assert pieces > len(texts) + 50


def test_stitching_recovers(enc):
    """Lines without spaces, Chinese prose, and one long token across a seam: later seams are cut again."""
    import regex
    rule, rng = regex.compile(P.PATTERN), random.Random(4)
    prose = " ".join(f"word{rng.randrange(99)}" for _ in range(30000))
    han = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃") + ("，" if rng.random() < .1 else "") for _ in range(200000))
    lines = "\n".join("x" * rng.randrange(5, 60) for _ in range(6000))
    digits = prose[:bpe.CHUNK - 1000] + " " + "7" * 3000 + " " + prose
    for t, least in ((han, 5), (lines, 5), (digits, 5), ("y" * 100000, 1)):
        parts = [(s, c, bpe.boundaries(rule, c, s)) for s, c in bpe.chunks(t, bpe.CHUNK, bpe.OVERLAP)]
        got = bpe.stitch(parts, rule)
        assert "".join(got) == t and len(got) >= least
        assert [i for x in got for i in bpe.encode(enc, x).tolist()] == enc.encode_ordinary(t)


def want_tokens(enc, text):
    ids = enc.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_tokenize_hard_rows_in_small_chunks(make_docs, hard_rows, enc):
    docs = make_docs(hard_rows)
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (300, 60)):
        got = bpe.digests(bpe.tokenize(docs, RANKS, P.PATTERN, chunk, overlap)).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(
            (str(i), *want_tokens(enc, t)) for i, t in hard_rows)
    assert bpe.tokenize(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_tokenize_documents(spark, sf, enc):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = bpe.digests(bpe.tokenize(table(spark, sf, "documents"), RANKS, P.PATTERN, 2000, 100)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {
        i: want_tokens(enc, t) for i, t in texts.items()}


def encoder(path=JSON):
    with open(path, "rb") as f:
        return repair.Encoder(f.read())


def test_fast_pre_tokens_equal_the_library(tokenizer, monkeypatch):
    rng = random.Random(2)
    texts = [noise(rng, rng.randrange(40)) for _ in range(3000)] + ["", None, "hello <|endoftext|> you"]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert want[-1] == [31373, 220, 50256, 345, 2]      # an added token's string is that token: the library's default
    for cache in (repair.CACHE, 30):
        monkeypatch.setattr(repair, "CACHE", cache)
        e = encoder()
        for a in range(0, len(texts), 400):
            ids, count = e.rows(pa.array(texts[a:a + 400], pa.string()))
            end = np.cumsum(count)
            assert [ids[e - c:e].tolist() for e, c in zip(end.tolist(), count.tolist())] == want[a:a + 400]


def test_equal_hashes_do_not_mix_ids(tokenizer, monkeypatch):
    texts = ["one two three", "two one", "three three", "other words here"] * 5
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    monkeypatch.setattr(repair, "mix", lambda z: z % np.uint64(3))       # nearly all hashes collide
    e = encoder()
    for a in range(0, len(texts), 2):
        ids, count = e.rows(pa.array(texts[a:a + 2]))
        assert ids.tolist() == sum(want[a:a + 2], []) and count.tolist() == list(map(len, want[a:a + 2]))


def test_other_patterns_go_to_the_library_whole():
    e = encoder(P.path("word_bpe_49k.json"))
    assert not e.by_class
    texts = ["Two Words\n", "don't 12", "<|startoftext|>x", None]
    ids, count = e.rows(pa.array(texts))
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == sum(want, []) and count.tolist() == list(map(len, want))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for case in range(200):
        docs = [rng.integers(0, rng.integers(1, 6) + 1, rng.integers(0, 300)).tolist() + [9] for _ in range(rng.integers(1, 9))]
        if case % 4 == 0:
            docs.append([3] * 101 + [9])
        ids = np.array(sum(docs, []), np.uint32)
        ends = np.cumsum([len(x) for x in docs])
        least = 2 + case % 3
        rules, lengths, sym, per = repair.compress(ids, ends, 10, least)
        assert np.array_equal(repair.expand(sym, rules, 10), ids)
        at = np.concatenate(([0], np.cumsum(per)))
        assert at[-1] == len(sym) and len(per) == len(docs)
        left = {}
        for k, x in enumerate(docs):
            own = sym[at[k]:at[k + 1]]
            assert repair.expand(own, rules, 10).tolist() == x
            p = int(rng.integers(0, len(x)))
            assert repair.id_at(own, rules, lengths, 10, p) == x[p]
            pairs, i = list(zip(own[:-1].tolist(), own[1:].tolist())), 0
            while i < len(pairs):
                left[pairs[i]] = left.get(pairs[i], 0) + 1
                i += 2 if i + 1 < len(pairs) and pairs[i] == pairs[i + 1] else 1
        # the grammar is complete: no pair is left that stands often enough, at any size
        assert all(n < least for n in left.values())


def want_shards(tokenizer, rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((str(i), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out)


def test_round_trip_of_hard_rows(make_docs, hard_rows, tokenizer):
    docs = make_docs(hard_rows)
    got = repair.round_trip(docs, JSON, shard_ids=500).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == want_shards(tokenizer, hard_rows)
    assert repair.round_trip(docs.limit(0), JSON).count() == 0


def test_round_trip_of_documents(spark, sf, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = repair.round_trip(table(spark, sf, "documents"), JSON).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == want_shards(tokenizer, rows)
