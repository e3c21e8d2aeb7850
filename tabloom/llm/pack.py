"""Sequences of power-of-two lengths: documents cut by the binary digits of their token counts.

A document of n ids gives n // MAX_LEN pieces of ``MAX_LEN`` and one piece for
each binary digit of the rest, longest first.  Every piece is a sequence of its
own, so no sequence crosses documents and none needs padding; sequences of
equal length form a bucket, from which equal-shaped batches are read.

The table is read once, without a shuffle.  Each task encodes its documents,
numbers its sequences and writes them to one file in the shared folder, ordered by
bucket (a filter on ``bucket`` reads only the row groups of that length).  Numbers
never change when an executor is lost later.

Ids: the tokenizer drops white space and nothing in it looks across ASCII white
space, so a text's ids are those of its words end to end.  In words of ASCII and Latin
letters its split is a matter of byte classes: they are cut into its pre-tokens, and each
distinct pre-token is encoded by the library's BPE model once while a worker keeps it
(at most ``KEPT`` of them; found by hash, then compared byte by byte).  Any other word goes
to the library whole.  ``word_wise`` checks the tokenizer file for that form; with any other file,
texts go to the library whole.

Null and empty texts hold the end id only (one piece of length 1).  Repeated
rows and repeated or null doc_ids are documents of their own.  An empty table
gives no pieces.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import per_worker, shared_dir
from tabloom.llm.repair import BYTE_LEVEL, plain_bytes
from tabloom.llm.textnp import IS_SPACE, slices, texts

END_ID = 1
MAX_LEN = 2048
KEPT = 800_000
# bytes of text encoded at a time
SLICE = 2 << 20

# fixed value: the pre-tokenizer pattern of the word tokenizer
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# the same over bytes, where every byte beyond ASCII belongs to a letter
_PLAIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\sa-z0-9\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_wise(config: dict) -> bool:
    """Whether the ids of a text are those of its ASCII-white-space words end to end.

    That holds where white space becomes a plain space, the pre-tokenizer keeps only
    matches that hold no white space, and added tokens hold none and do not strip it.
    """
    steps = (config.get("normalizer") or {}).get("normalizers") or []
    if not any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps):
        return False
    if any(s.get("type") not in ("NFC", "Replace", "Lowercase") for s in steps) or sum(s["type"] == "Replace" for s in steps) > 1:
        return False
    pre = (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if not pre or pre[0].get("type") != "Split" or pre[0].get("pattern") != {"Regex": PATTERN} \
            or pre[0].get("behavior") != "Removed" or not pre[0].get("invert"):
        return False
    if any(p.get("type") != "ByteLevel" or p.get("add_prefix_space") or p.get("use_regex") for p in pre[1:]):
        return False
    if config.get("model", {}).get("type") != "BPE" or config["model"].get("dropout"):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
                   or not t["content"].startswith("<|")
                   for t in config.get("added_tokens") or [])


class WordIds:
    """Ids of texts by the tokenizers library, each distinct pre-token encoded once while it is kept.

    Kept words are arrays (about 50 bytes a word): their hashes in ascending order, and for each
    word its bytes and its ids in two pools.
    """

    def __init__(self, raw: bytes, kept: int = KEPT):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(raw)
        self.by_word = word_wise(json.loads(raw))
        self.kept = kept
        self._clear()

    def _clear(self):
        self.hash, self.word = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.text_end, self.ids_end = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _encode(self, strings: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([s.decode("utf-8", "replace") for s in strings],
                                                           add_special_tokens=False)]

    def _one(self, word: bytes) -> list[int]:
        """Ids of one plain pre-token."""
        text = word.decode() if word.isalnum() else word.decode().lower().encode().decode("latin-1").translate(BYTE_LEVEL)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _learn(self, words: list[bytes], whole: set[bytes], hashes: np.ndarray):
        ids = [self._one(w) if w not in whole else None for w in words]
        odd = [k for k, i in enumerate(ids) if i is None]
        for k, i in zip(odd, self._encode([words[k] for k in odd])):
            ids[k] = i
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.text_end) - 1
        self.ids = np.append(self.ids, np.fromiter((i for w in ids for i in w), np.uint32, int(size.sum())))
        self.ids_end = np.append(self.ids_end, self.ids_end[-1] + np.cumsum(size))
        self.text = np.append(self.text, np.frombuffer(b"".join(words), np.uint8))
        self.text_end = np.append(self.text_end, self.text_end[-1] + np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        order = np.argsort(hashes)
        place = np.searchsorted(self.hash, hashes[order])
        self.hash = np.insert(self.hash, place, hashes[order])
        self.word = np.insert(self.word, place, (first + order).astype(np.int32))

    def _find(self, words: list[bytes], whole: set[bytes]) -> np.ndarray:
        """Number of each kept word; new ones are encoded."""
        n = len(words)
        hashes = np.fromiter(map(hash, words), np.int64, n)
        size = np.fromiter(map(len, words), np.int64, n)
        out, have = np.zeros(n, np.int64), np.zeros(n, bool)
        if len(self.hash) and n:
            i = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
            out = self.word[i].astype(np.int64)
            begin = self.text_end[out]
            have = (self.hash[i] == hashes) & (self.text_end[out + 1] - begin == size)
            # equal hashes and lengths: compare the bytes
            k = np.flatnonzero(have)
            if len(k):
                blob, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
                head = np.cumsum(size[k]) - size[k]
                inside = np.arange(int(size[k].sum())) - np.repeat(head, size[k])
                same = blob[np.repeat(at[k], size[k]) + inside] == self.text[np.repeat(begin[k], size[k]) + inside]
                have[k] = np.logical_and.reduceat(same, head)
        new = np.flatnonzero(~have)
        if len(new):
            if len(self.hash) + len(new) > self.kept:
                self._clear()
                new = np.arange(n)
            out[new] = len(self.text_end) - 1 + np.arange(len(new))
            self._learn([words[k] for k in new.tolist()], whole, hashes[new])
        return out

    def rows(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, ids per row)."""
        data, offs = texts(col)
        raw, bounds = data.tobytes(), offs.tolist()
        if not self.by_word:
            ids = self._encode([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for r in ids for i in r), np.uint32, int(count.sum())), count
        low = raw.translate(_LOWER)
        odd, whole = odd_words(data, offs), set()
        split = []
        for a, b, words in zip(bounds[:-1], bounds[1:], odd):
            if not words:
                split.append(_PLAIN.findall(low, a, b))
                continue
            units = []
            for x, y in words:
                units += _PLAIN.findall(low, a, x)
                units.append(raw[x:y])
                whole.add(raw[x:y])
                a = y
            units += _PLAIN.findall(low, a, b)
            split.append(units)
        words = [w for r in split for w in r]
        distinct = list(dict.fromkeys(words))
        number = self._find(distinct, whole)
        place = dict(zip(distinct, range(len(distinct))))
        entry = number[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
        start = self.ids_end[entry]
        size = self.ids_end[entry + 1] - start
        end = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(end[-1]) + np.repeat(start - end[:-1], size)]
        row = np.concatenate(([0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))))
        return ids, np.diff(end[row])


def odd_words(data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per row the (begin, end) bytes of the words that are not plain or may hold an added token."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offs) - 1)]
    bad = ~plain_bytes(data)
    bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)       # <|
    bad[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)    # U+0130, whose lower case is a letter and a mark
    at = np.flatnonzero(bad)
    if len(at):
        space = np.concatenate(([-1], np.flatnonzero(IS_SPACE[data]), [len(data)]))
        k = np.searchsorted(space, at)
        row = np.searchsorted(offs, at, side="right") - 1
        begin, end = np.maximum(space[k - 1] + 1, offs[row]), np.minimum(space[k], offs[row + 1])
        first = np.flatnonzero(np.concatenate(([True], begin[1:] != begin[:-1])))
        for r, x, y in zip(row[first].tolist(), begin[first].tolist(), end[first].tolist()):
            out[r].append((x, y))
    return out


def binary_pieces(count: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, length) of the pieces of rows of ``count`` ids, in row order, longest first."""
    digits = max_len.bit_length() - 1
    powers = 1 << np.arange(digits - 1, -1, -1)
    whole = np.repeat(np.arange(len(count)), count // max_len)
    row, k = np.nonzero((count % max_len)[:, None] & powers)
    rows = np.concatenate((whole, row))
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate((np.full(len(whole), max_len), powers[k]))[order]


PIECES = "doc_id {kind}, start long, length int, doc_tokens long, sequence_id long, ids binary, bucket int"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """The sequences: doc_id, start, length, doc_tokens, sequence_id, ids (little-endian
    unsigned 32-bit), bucket (the power of two of the length).

    Written as Parquet, ordered by bucket within each file, and read back from there.  sequence_id
    is the task's number times 2^32 plus a running number; ``max_len`` is a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError(f"max_len must be a power of two, not {max_len}")
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    sent = spark.sparkContext.broadcast(raw)     # as large as its vocabulary
    key = hashlib.sha256(raw).hexdigest()
    schema = PIECES.format(kind=dict(docs.dtypes)["doc_id"])

    def run(batches):
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = per_worker(f"word ids {key}", lambda: WordIds(sent.value))
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                body, count = encoder.rows(part.column("text"))
                total = count + 1
                last = np.cumsum(total) - 1
                ids = np.empty(int(total.sum()), "<u4")
                fill = np.ones(len(ids), bool)
                fill[last] = False
                ids[fill], ids[last] = body, end_id
                row, length = binary_pieces(total, max_len)
                # pieces in this order tile the ids
                end = np.concatenate(([0], np.cumsum(length)))
                cuts = pa.py_buffer((4 * end).astype(np.int64))
                cut = pa.Array.from_buffers(pa.large_binary(), len(length), [None, cuts, pa.py_buffer(ids)])
                yield pa.record_batch([
                    part.column("doc_id").take(pa.array(row)), pa.array(end[:-1] - (last + 1 - total)[row]),
                    pa.array(length.astype(np.int32)), pa.array(total[row]),
                    pa.array((task << 32) + n + np.arange(len(length))), cut.cast(pa.binary()),
                    pa.array((np.frexp(length)[1] - 1).astype(np.int32))],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "ids", "bucket"])
                n += len(length)

    path = f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex[:12]}"
    docs.select("doc_id", "text").mapInArrow(run, schema).sortWithinPartitions("bucket").write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def digests(sequences: DataFrame) -> DataFrame:
    """One row per piece with the CRC-32 of its ids; each sequence is one piece, at offset 0."""
    return sequences.select("doc_id", "start", F.col("length").cast("long").alias("length"),
                            F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                            F.lit(0).cast("long").alias("offset"))
