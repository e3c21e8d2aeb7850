"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of up to ``CHUNK`` code points is one chunk.  Longer texts are cut into
chunks that overlap their left neighbour by ``OVERLAP``; chunks are
pre-tokenised in parallel, each from its own start.  A match depends only on
the text from its start on, so from the first boundary that two neighbouring
chunks have in common in their overlap the right one is in step; the texts
between such points are the pieces, encoded in parallel and put together
in order.  Where neighbours have no common boundary in their overlap (one token
runs through it), the joined text is scanned on from the last boundary known to be
right until it meets one of the right chunk, so later chunks are in step again and
the result is that of the whole text for any chunk size.

A text is cut at boundaries after anything but white space: the one rule that looks
ahead is about white space.  Both characters there have had their class since
Unicode 3.2, so that two libraries of different Unicode versions agree on the boundary.

Decoding concatenates the raw bytes of the ids.  The rank file (a path
parameter) is read once by the driver and broadcast: its size is fixed by the
vocabulary.  Null and empty texts have no ids and decode to no bytes; repeated
rows give repeated result rows (rows, not ids, are regrouped).
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import written
from tabloom.llm.textnp import slices

CHUNK = 1 << 15
OVERLAP = 1 << 9

OUT = "n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(enc, text: str) -> np.ndarray:
    return np.asarray(enc.encode_to_numpy(text, disallowed_special=()), dtype="<u4") if text else np.zeros(0, "<u4")


def decode(enc, ids: np.ndarray) -> bytes:
    return enc.decode_bytes(ids.tolist())


def chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk text); each chunk but the first begins ``overlap`` early."""
    return [(max(0, a - overlap), text[max(0, a - overlap): a + size]) for a in range(0, max(len(text), 1), size)]


def boundaries(pattern, text: str, start: int) -> list[int]:
    """Absolute starts of the pre-tokens, but for the last three, which the chunk's end may have cut."""
    return [start + m.start() for m in pattern.finditer(text)][:-3]


def stable(c: str) -> bool:
    """Whether a character is white space, letter, number or other in all Unicode versions since 3.2."""
    old = unicodedata.ucd_3_2_0.category(c)
    return old[0] not in "C" and old[0] == unicodedata.category(c)[0]


def stitchable(text: str, at: int) -> bool:
    left, right = text[at - 1], text[at]
    return not left.isspace() and stable(left) and (right.isspace() or stable(right))


def stitch(parts: list[tuple[int, str, list[int]]], pattern) -> list[str]:
    """Pieces of the whole text from (start, chunk, boundaries) in order."""
    pieces, begin, text = [], 0, parts[0][1]       # text: from `begin` on, as far as the chunks reach
    known = set(parts[0][2])                       # boundaries of the whole text
    for start, chunk, bounds in parts[1:]:
        fresh = begin + len(text) - start          # length of the overlap
        point = next((p for p in bounds if p > max(start, begin) and p < start + fresh and p in known
                      and stitchable(chunk, p - start)), None)
        text += chunk[fresh:]
        if point is None:
            # scan on from the last known boundary until the right chunk is in step
            own, seen = set(boundaries(pattern, chunk, start)), []
            last = max((p for p in known if p >= begin), default=begin)
            for m in pattern.finditer(text, last - begin):
                p = begin + m.start()
                seen.append(p)
                if p > max(start, begin) and p in own and stitchable(text, m.start()):
                    point = p
                    break
            if point is None:
                known = set(seen[:-3])
                continue
            bounds = own
        pieces.append(text[: point - begin])
        text, begin, known = text[point - begin:], point, set(bounds)
    return [*pieces, text]


def _tokens(batch_id: pa.Array, texts: list[str | None], enc, names: list[str]):
    ids = [encode(enc, t or "") for t in texts]
    return pa.record_batch([
        batch_id, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
        pa.array([decode(enc, x) for x in ids], pa.binary())], names=names)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded bytes of every document."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = dict(docs.dtypes)["doc_id"]

    def whole(batches):
        enc = encoding(sent.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                yield _tokens(part.column("doc_id"), part.column("text").to_pylist(), enc,
                              ["doc_id", "n_tokens", "ids", "decoded"])

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                uid, doc, text = (batch.column(c)[i] for c in ("uid", "doc_id", "text"))
                got = chunks(text.as_py(), chunk, overlap)
                n = len(got)
                yield pa.record_batch([
                    pa.array([uid.as_py()] * n, uid.type), pa.array([doc.as_py()] * n, doc.type),
                    pa.array(range(n), pa.int32()), pa.array([s for s, _ in got], pa.int64()),
                    pa.array([t for _, t in got], pa.string())], names=["uid", "doc_id", "part", "start", "text"])

    def scan(batches):
        import regex
        rule = regex.compile(pattern)
        for batch in batches:
            got = [boundaries(rule, t, s)
                   for t, s in zip(batch.column("text").to_pylist(), batch.column("start").to_pylist())]
            # only those of the overlaps are compared
            near = [[p for p in b if p - s < overlap or p - s >= len(t) - overlap]
                    for b, s, t in zip(got, batch.column("start").to_pylist(), batch.column("text").to_pylist())]
            yield batch.append_column("bounds", pa.array(near, pa.list_(pa.int64())))

    def pieces(g: pd.DataFrame) -> pd.DataFrame:
        import regex
        g = g.sort_values("part")
        got = stitch([(s, t, list(b)) for s, t, b in zip(g["start"], g["text"], g["bounds"])], regex.compile(pattern))
        return pd.DataFrame({"uid": g["uid"].iloc[0], "doc_id": [g["doc_id"].iloc[0]] * len(got),
                             "part": range(len(got)), "text": got})

    def encode_pieces(batches):
        enc = encoding(sent.value, pattern)
        for batch in batches:
            out = _tokens(batch.column("uid"), batch.column("text").to_pylist(), enc, ["uid", "n_tokens", "ids", "decoded"])
            yield pa.record_batch([out.column("uid"), batch.column("doc_id"), batch.column("part"),
                                   out.column("ids"), out.column("decoded")],
                                  names=["uid", "doc_id", "part", "ids", "decoded"])

    def together(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        ids = b"".join(g["ids"])
        return pd.DataFrame({"doc_id": [g["doc_id"].iloc[0]], "n_tokens": [len(ids) // 4], "ids": [ids],
                             "decoded": [b"".join(g["decoded"])]})

    rows = docs.select("doc_id", "text")
    long_ = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    out = f"doc_id {kind}, {OUT}"
    short = rows.where(~long_).mapInArrow(whole, out)
    # written first: a row's number then is the same however often a task is run again
    numbered = written(rows.where(long_).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), "long-texts")
    parts = numbered.mapInArrow(cut, f"uid long, doc_id {kind}, part int, start long, text string")
    scanned = parts.repartition("uid", "part").mapInArrow(
        scan, f"uid long, doc_id {kind}, part int, start long, text string, bounds array<long>")
    stitched = scanned.groupBy("uid").applyInPandas(pieces, f"uid long, doc_id {kind}, part int, text string")
    coded = stitched.repartition("uid", "part").mapInArrow(
        encode_pieces, f"uid long, doc_id {kind}, part int, ids binary, decoded binary")
    return short.unionByName(coded.groupBy("uid").applyInPandas(together, out))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded bytes."""
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))
