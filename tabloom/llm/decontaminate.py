"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items are reduced to their words, lower-cased and joined by single
spaces with one at each end, so a window of consecutive words occurs in a
document exactly where its string occurs in the document's string.  The search
reads the last ``block`` bytes under the current position: the shift table
tells how far to skip; a shift of 0 selects the bucket of patterns that end
with this block, and these are compared directly.

Windows of one length class (10 words; items with fewer words by their own
count) are searched together, so a short item shortens no other shift.

The patterns are broadcast in parts of at most ``PART_BYTES`` of item text,
whatever the size of the benchmark; every task runs each part over its rows, and a
worker holds one part's tables, built once for all its tasks where there is one part.  No shuffle, no collected document.

Null, empty or wordless texts have no words, no hits and the hash of the empty
string; null or wordless items have no windows; rows that share an item_id are one
item with the windows of all of them; a null item_id is listed as an empty string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import per_worker

WINDOW = 10
PART_BYTES = 32 << 20

# a byte to itself if it belongs to a word (0-9, a-z, non-ASCII), A-Z lowered, all else to a space
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
                   for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def canonical(ws: list[bytes]) -> bytes:
    return b" " + b" ".join(ws) + b" " if ws else b""


def windows(ws: list[bytes], size: int) -> list[bytes]:
    """Strings of every ``size`` consecutive words; a shorter item is one window."""
    if not ws:
        return []
    return [canonical(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))]


class WuManber:
    """Shift and bucket tables of one class of patterns."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        # a block long enough that few blocks of ordinary text are in the table
        self.block = b = max(1, min(12, m // 3))
        self.default = m - b + 1
        shift: dict[bytes, int] = {}
        bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(b, m + 1):
                q, s = p[end - b:end], m - end
                if shift.get(q, self.default) > s:
                    shift[q] = s
            bucket.setdefault(p[m - b:m], []).append(p)
        self.shift, self.bucket = shift, bucket

    def search(self, text: bytes) -> list[tuple[int, bytes]]:
        """(start, pattern) of every occurrence."""
        out = []
        m, b, n = self.m, self.block, len(text)
        get, default, bucket = self.shift.get, self.default, self.bucket
        end = m
        while end <= n:
            q = text[end - b:end]
            s = get(q, default)
            if s:
                end += s
                continue
            at = end - m
            for p in bucket[q]:
                if text.startswith(p, at):
                    out.append((at, p))
            end += 1
        return out


def tables(items: list[tuple[str, bytes]], size: int) -> tuple[list[WuManber], dict[bytes, list[str]]]:
    """One matcher per window length class, and the item ids of each window."""
    owner: dict[bytes, list[str]] = {}
    classes: dict[int, list[bytes]] = {}
    for item, text in items:
        ws = text.split()
        for w in set(windows(ws, size)):
            if w not in owner:
                classes.setdefault(min(len(ws), size), []).append(w)
            owner.setdefault(w, []).append(item)
    return [WuManber(sorted(p)) for _, p in sorted(classes.items())], owner


def hits(text: bytes, matchers: list[WuManber]) -> list[tuple[int, int, bytes]]:
    return [(at, at + len(p), p) for m in matchers for at, p in m.search(text)]


def covered_words(text: bytes, spans: list[tuple[int, int]]) -> int:
    """Words of a canonical text inside the union of the spans (each begins and ends at a space)."""
    total, last = 0, 0
    for a, b in sorted(spans):
        a = max(a, last)
        if b - 1 > a:
            total += text.count(b" ", a, b) - 1
            last = b - 1
    return total


def _parts(benchmark: DataFrame, part_bytes: int) -> list:
    """(digest, broadcast) of (item id, canonical text) lists, each of at most about ``part_bytes``."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // part_bytes)
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = part.toArrow().to_pylist()
        held = sorted((r["item"], canonical(words(r["text"]))) for r in rows)
        digest = hashlib.sha256(repr(held).encode()).hexdigest()
        out.append((digest, spark.sparkContext.broadcast(held)))
    return out


def _searched(parts: list, size: int):
    """Function over batches: word counts, hit words and items of each row's ``__text``."""
    def measure(batch: pa.RecordBatch):
        # the tables serve all tasks of a worker; one part's tables at a time
        built = per_worker("wu-manber", dict)
        col = batch.column("__text")
        texts = [words(t) for t in col.to_pylist()]
        n_words = [len(t) for t in texts]
        texts = [canonical(t) for t in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for digest, sent in parts:
            if (digest, size) not in built:
                built.clear()
                built[digest, size] = tables(sent.value, size)
            matchers, owner = built[digest, size]
            for i, t in enumerate(texts):
                found = hits(t, matchers)
                if found:
                    spans[i] += [(a, b) for a, b, _ in found]
                    for p in {p for _, _, p in found}:
                        items[i].update(owner[p])
        hit = [covered_words(t, s) for t, s in zip(texts, spans)]
        return n_words, hit, items
    return measure


def _rows(batch: pa.RecordBatch, limit: int = 4096):
    for a in range(0, batch.num_rows, limit):
        yield batch.slice(a, limit)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the item ids of every document."""
    measure = _searched(_parts(benchmark, part_bytes), window)

    def run(batches):
        for batch in batches:
            for rows in _rows(batch):
                n, hit, items = measure(rows)
                ids = [sorted(x) for x in items]
                yield pa.record_batch([
                    rows.column("__id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]),
                    pa.array(np.array(hit) > 0), pa.array(ids, pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, "
                                "items_sha256 string, contaminated boolean, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    measure = _searched(_parts(benchmark, part_bytes), window)

    def run(batches):
        for batch in batches:
            for rows in _rows(batch):
                clean = pa.array(np.array(measure(rows)[1]) == 0)
                yield pa.record_batch([rows.column("__doc").filter(clean)], names=["__doc"])

    rows = docs.select(F.struct("*").alias("__doc"), F.col("text").alias("__text"))
    return rows.mapInArrow(run, rows.select("__doc").schema).select("__doc.*")
