"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lowered, digits to 0, white space collapsed) and
hashed; per host (``source``) the distinct documents that hold a line are
counted; lines above the limit are removed, and documents that lose most of
their words that way are rejected.

Three passes over the texts, small shuffles between them:

1. ``mapInArrow``: per document the hashes of its distinct lines.  Exact
   copies within a host become one row before lines are exploded, so a
   thousand copies count once.  ``groupBy(line)`` aggregates on the map side, so
   a line in every document is a few rows per task.  Lines in at most
   ``max_docs`` distinct texts are done with.
2. Only for documents with a line above the limit: ``MINIMA`` minimum hashes of
   the word trigrams outside that line.
3. ``mapInArrow``: base measures, removed words and the verdict, row by row.

A line counts as boilerplate when more than ``max_docs`` documents of the host
hold it, each group of near copies counted as one document: near copies are
left to near-dedup.  A holder weighs 1/g, where g of the line's holders have
the same minimum hash as it, for all but ``OWN_MINIMA`` of its ``MINIMA``
hashes.  Near copies share nearly all of them; documents that share a template
but differ in more than a sixth of their trigrams do not.

The lines above the limit are broadcast only if there are at most
``broadcast_lines`` of them; beyond that each distinct text is joined to its
own removed lines by shuffle, with the same result.

Null texts have no words, are base-failed and kept = false; a null host is a
host of its own; repeated rows give repeated result rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabloom.llm.common import written
from tabloom.llm.textnp import IS_SPACE, LOWER, Words, mix, row_sums, segment_hash, slices, texts

MAX_DOCS = 100          # distinct documents of a host that may share a line
MINIMA = 24             # minimum trigram hashes of a document outside a line
OWN_MINIMA = 4          # of them that a near copy may have to itself
DEPLETED_PCT = 70       # a document that loses more of its words is rejected
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
BROADCAST_LINES = 1_000_000   # 8 bytes each

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
NORMAL = LOWER.copy()
NORMAL[48:58] = 48
_U = np.uint64


def _line_starts(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each line that has a word, and the row of that line."""
    if not len(w.starts):
        z = np.zeros(0, np.int64)
        return z, z
    row = np.repeat(np.arange(len(w.count)), w.count)
    line = np.cumsum(data == 10)[w.starts] + row
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    return first, row[first]


def _line_keys(data: np.ndarray, w: Words, host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(host, normalised line) hash, row and word count of each line."""
    first, row = _line_starts(data, w)
    key = mix(segment_hash(w.hash, first) + host[row] * _U(0x9E3779B97F4A7C15))
    return key, row, np.diff(np.append(first, len(w.starts)))


def _host(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("__host").to_numpy(zero_copy_only=False).astype(np.int64).view(_U)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offs = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values.view(np.int64)))


LINES = "host long, text long, lines array<long>"
SIGNED = "line long, text long, sigs array<long>"


def _rest_signatures(w: Words, first: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Per line (rows) ``MINIMA`` minimum trigram hashes of its document outside the line (0 if there is none)."""
    top = _U(0xFFFFFFFFFFFFFFFF)
    tri, at = w.shingles(3)
    place = np.arange(len(tri)) + np.repeat(w.row[:-1] - at[:-1], np.diff(at))
    by_word = np.full(len(w.hash), top, _U)
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    starts, which = np.flatnonzero(new_row), np.cumsum(new_row) - 1
    out = np.empty((len(first), MINIMA), _U)
    for j in range(MINIMA):
        by_word[place] = mix(tri ^ _U((j * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        own = np.minimum.reduceat(by_word, first)
        least = np.minimum.reduceat(own, starts)[which]
        rest = np.minimum.reduceat(np.where(own == least, top, own), starts)[which]
        sig = np.where(own == least, rest, least)
        out[:, j] = np.where(sig == top, _U(0), sig)
    return out


def _document_lines(batches):
    """host, text key and distinct line keys of each document with words."""
    for batch in batches:
        for part in slices(batch, "__text"):
            data, offs = texts(part.column("__text"))
            w = Words(data, offs, NORMAL)
            has = w.count > 0
            if not has.any():
                continue
            host = _host(part)
            key, row, _ = _line_keys(data, w, host)
            order = np.lexsort((key, row))
            key, row = key[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            counts = np.bincount(row[new], minlength=len(w.count))[has]
            text = segment_hash(w.hash, w.row[:-1][has], 7)
            yield pa.record_batch([pa.array(host[has].view(np.int64)), pa.array(text.view(np.int64)),
                                   _lists(key[new], counts)], names=["host", "text", "lines"])


def _flagged(part: pa.RecordBatch, key: np.ndarray, row: np.ndarray, removed: np.ndarray | None) -> np.ndarray:
    """Which lines are listed: in the sorted keys ``removed`` or, if None, in their row's own ``__removed``."""
    if removed is not None:
        at = np.searchsorted(removed, key)
        return removed[np.minimum(at, len(removed) - 1)] == key
    own = [set(x or ()) for x in part.column("__removed").to_pylist()]
    return np.fromiter((k in own[r] for k, r in zip(key.view(np.int64).tolist(), row.tolist())), bool, len(key))


def _signed_lines(part: pa.RecordBatch, removed: np.ndarray | None):
    """line, text key and signature outside the line of each listed line of a slice, or None."""
    data, offs = texts(part.column("__text"))
    w = Words(data, offs, NORMAL)
    if not len(w.starts):
        return None
    key, row, _ = _line_keys(data, w, _host(part))
    bad = np.flatnonzero(_flagged(part, key, row, removed))
    if not len(bad):
        return None
    held = np.zeros(len(w.count), bool)
    held[row[bad]] = True
    if not held.all():                      # hash only the documents that hold such a line
        return _signed_lines(part.filter(pa.array(held)), removed)
    sig = _rest_signatures(w, *_line_starts(data, w))[bad]
    text = np.zeros(len(w.count), _U)
    text[w.count > 0] = segment_hash(w.hash, w.row[:-1][w.count > 0], 7)
    return pa.record_batch([pa.array(key[bad].view(np.int64)), pa.array(text[row[bad]].view(np.int64)),
                            _lists(sig.ravel(), np.full(len(bad), MINIMA))], names=["line", "text", "sigs"])


def _prepared(docs: DataFrame, *extra) -> DataFrame:
    return docs.select(*extra, F.col("text").alias("__text"),
                       F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\0null"))).alias("__host"))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(line): keys of the host lines above the limit, a group of near copies counted once."""
    per_doc = _prepared(docs).mapInArrow(_document_lines, LINES)
    distinct = per_doc.groupBy("host", "text").agg(F.first("lines").alias("lines"))
    shared = written(distinct.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("docs"))
                     .where(F.col("docs") > max_docs).select("line"), "shared-lines")
    flagged, sent = _with_removed(docs, shared, broadcast_lines)
    if sent is not None and not len(sent.value):
        return shared
    rows = _prepared(docs)
    if flagged is not None:
        rows = _rows_with_removed(rows, flagged)

    def sign(batches):
        removed = sent.value if sent is not None else None
        for batch in batches:
            for part in slices(batch, "__text"):
                got = _signed_lines(part, removed)
                if got is not None:
                    yield got

    signed = written(rows.mapInArrow(sign, SIGNED).groupBy("line", "text").agg(F.first("sigs").alias("sigs")), "signed-lines")
    minima = signed.select("line", "text", F.posexplode("sigs").alias("j", "sig"))
    groups = minima.groupBy("line", "j", "sig").agg(F.count("*").alias("n"))
    size = F.sort_array(F.collect_list("n"))[OWN_MINIMA]
    weighed = minima.join(groups, ["line", "j", "sig"]).groupBy("line", "text").agg(size.alias("size"))
    # the slack is for sums of fractions only
    return written(weighed.groupBy("line").agg(F.sum(1 / F.col("size")).alias("docs"))
                   .where(F.col("docs") > max_docs + 1e-6).select("line"), "frequent-lines")


def measure(part: pa.RecordBatch, removed: np.ndarray | None) -> dict[str, np.ndarray]:
    """Base measures and verdict of a slice; ``removed``: sorted line keys, or None to use each
    row's own ``__removed`` list."""
    data, offs = texts(part.column("__text"))
    raw = Words(data, offs)
    n = len(raw.count)
    lead = (data & 0xC0) != 0x80
    out = {"n_words": raw.count.astype(np.int64),
           "word_chars": row_sums(lead & ~raw.space, offs),
           "n_symbols": row_sums(SYMBOL[data], offs)}

    dup = np.zeros(n, np.int64)
    raw_bytes = data.tobytes()
    for i in np.flatnonzero(row_sums(data == 10, offs)):
        lines = [x for x in raw_bytes[offs[i]:offs[i + 1]].split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup

    hit = np.zeros(len(raw.hash) + 2, bool)
    full = raw.count >= 3
    if full.any():
        tri, at = raw.shingles(3)
        row = np.repeat(np.arange(n), np.diff(at))
        keep = full[row]
        pos = (np.arange(len(tri)) - np.repeat(at[:-1] - raw.row[:-1], np.diff(at)))[keep]
        key = mix(tri[keep] + row[keep].astype(_U) * _U(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] = same
        twice[:-1] |= same
        at_word = pos[order[twice]]
        for j in range(3):
            hit[at_word + j] = True
    out["n_repeat_words"] = row_sums(hit[: len(raw.hash)], raw.row)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PCT * out["n_words"])

    gone = np.zeros(n, np.int64)
    if removed is None or len(removed):
        w = Words(data, offs, NORMAL)
        key, row, words = _line_keys(data, w, _host(part))
        bad = _flagged(part, key, row, removed)
        gone = np.bincount(row[bad], weights=words[bad], minlength=n).astype(np.int64)
        out["__lines"] = (row, bad)
    out["removed_words"] = gone
    out["kept"] = ~out["base_failed"] & ~(100 * gone > DEPLETED_PCT * out["n_words"])
    return out


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed",
             "kept"]
_MEASURE_DDL = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in _MEASURES)


def _with_removed(docs: DataFrame, lines: DataFrame, broadcast_lines: int):
    """(prepared rows, broadcast of sorted line keys or None): the bounded or the shuffled way."""
    spark = docs.sparkSession
    # fetch one more than the bound: its length tells whether the bound holds
    got = lines.limit(broadcast_lines + 1).toArrow().column("line").to_numpy()
    if len(got) <= broadcast_lines:
        return None, spark.sparkContext.broadcast(np.sort(got.astype(np.int64).view(_U)))
    per_doc = _prepared(docs).mapInArrow(_document_lines, LINES)
    flagged = (per_doc.groupBy("host", "text").agg(F.first("lines").alias("lines"))
               .select("host", "text", F.explode("lines").alias("line")).join(lines, "line", "left_semi")
               .groupBy("host", "text").agg(F.collect_list("line").alias("removed")))
    return flagged, None


def _keyed(batches):
    """Add each row's text key, for the shuffled way."""
    for batch in batches:
        for part in slices(batch, "__text"):
            data, offs = texts(part.column("__text"))
            w = Words(data, offs, NORMAL)
            has = w.count > 0
            key = np.zeros(len(has), np.int64)
            key[has] = segment_hash(w.hash, w.row[:-1][has], 7).view(np.int64)
            yield part.append_column("__key", pa.array(key))


def _rows_with_removed(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    schema = StructType([*rows.schema.fields, StructField("__key", LongType())])
    keyed = rows.mapInArrow(_keyed, schema)
    f = flagged.select(F.col("host").alias("__host"), F.col("text").alias("__key"), F.col("removed").alias("__removed"))
    return keyed.join(f, ["__host", "__key"], "left")


def quality(docs: DataFrame, max_docs: int = MAX_DOCS,
            broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, the base measures, removed_words and the verdict of every document."""
    flagged, sent = _with_removed(docs, frequent_lines(docs, max_docs, broadcast_lines), broadcast_lines)
    rows = _prepared(docs, F.col("doc_id").alias("__id"))
    if flagged is not None:
        rows = _rows_with_removed(rows, flagged)

    def judge(batches):
        removed = sent.value if sent is not None else None
        for batch in batches:
            for part in slices(batch, "__text"):
                m = measure(part, removed)
                yield pa.record_batch([part.column("__id"), *(pa.array(m[c]) for c in _MEASURES)],
                                      names=["doc_id", *_MEASURES])

    return rows.mapInArrow(judge, f"doc_id {dict(docs.dtypes)['doc_id']}, {_MEASURE_DDL}")


def filter_quality(docs: DataFrame, max_docs: int = MAX_DOCS,
                   broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The kept documents with all their columns, lines above the limit removed from their texts.

    ``n_chars``, where it is a whole number column, follows the new text.
    """
    flagged, sent = _with_removed(docs, frequent_lines(docs, max_docs, broadcast_lines), broadcast_lines)
    rows = _prepared(docs, F.struct("*").alias("__doc"))
    if flagged is not None:
        rows = _rows_with_removed(rows, flagged)

    def keep(batches):
        removed = sent.value if sent is not None else None
        for batch in batches:
            for part in slices(batch, "__text"):
                m = measure(part, removed)
                kept = np.flatnonzero(m["kept"])
                text = part.column("__text").take(pa.array(kept)).to_pylist()
                if "__lines" in m and m["__lines"][1].any():
                    row, bad = m["__lines"]
                    at = np.searchsorted(row, np.arange(part.num_rows + 1))
                    for k in np.flatnonzero(m["removed_words"][kept]):
                        i = kept[k]
                        text[k] = without_lines(text[k], bad[at[i]:at[i + 1]])
                yield pa.record_batch([part.column("__doc").take(pa.array(kept)), pa.array(text, pa.string())],
                                      names=["__doc", "__new"])

    out = rows.mapInArrow(keep, rows.select("__doc", F.col("__text").alias("__new")).schema)
    whole = {"tinyint", "smallint", "int", "bigint"}
    return out.select(*(
        F.col("__new").alias(c) if c == "text"
        else F.char_length("__new").cast(t).alias(c) if c == "n_chars" and t in whole
        else F.col("__doc").getField(c).alias(c) for c, t in docs.dtypes))


def without_lines(text: str, bad: np.ndarray) -> str:
    """``text`` without the flagged ones of its lines that have a word."""
    out, k = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            k += 1
            if bad[k - 1]:
                continue
        out.append(line)
    return "\n".join(out)


__all__ = ["quality", "filter_quality", "frequent_lines", "IS_SPACE"]
