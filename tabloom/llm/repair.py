"""Token ids compressed by Re-Pair grammars, in files with random access.

Documents are range-partitioned and sorted by doc_id (the sampling reads that
column only); each task encodes its documents, appends the end id, and cuts the
stream at document ends into shards of about ``SHARD_IDS`` ids.  Per shard the
most frequent id pairs are repeatedly replaced by nonterminals until none stands
``LEAST`` times (a rule for a pair of two places saves nothing); pairs never cross
a document end.  Pair counts and places are kept and changed only beside replaced
pairs: a round replaces the pairs of at least a quarter of the largest count, the more
frequent first where they overlap.

File format: Parquet rows in the shared folder, one per shard: task and shard
number, ids before it within the task, doc_ids, ids per document, symbols per
document, then little-endian unsigned 32-bit arrays of the rules (pairs), their
expansion lengths, and the symbols.  Symbols below ``vocabulary`` are ids, the
rest are rules.  A document decodes alone: its symbols are known, and the
expansion lengths give the place of any id in it.

Pre-tokens are found by numpy over the bytes of plain texts (ASCII and Latin
letters, where the tokenizer's pattern is a matter of byte classes); each
distinct one is encoded by the tokenizers library and kept in a table of at most
``CACHE`` entries, found by hash and compared byte by byte.  Any other text, and any
that holds the string of an added token, goes to the library whole, with its default
settings; so does every text where the file's pre-tokenizer or normaliser is another.

Null and empty texts hold the end id only.  Null doc_ids come first, repeated
doc_ids are ordered by text hash; rows equal in both are interchangeable.
An empty table writes no shard and gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import per_worker, shared_dir, shuffles_dropped
from tabloom.llm.textnp import BYTE_VALUE, mix, powers, slices, texts

END_ID = 2
SHARD_IDS = 1 << 18
LEAST = 3
CACHE = 1 << 20
_U = np.uint64

# byte classes of plain texts: 1 letter, 2 digit, 3 white space, 4 other, 0 not plain by itself
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
CLASS[48:58] = _DIGIT
CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
# bytes that no plain text has: separators some patterns count as white space, lead bytes beyond U+024F
ODD = np.zeros(256, bool)
ODD[[*range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xCA, 256)]] = True


def plain_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII (without its four separators) and of U+00C0-U+024F without the two signs (U+00D7, U+00F7)."""
    odd = ODD[data]
    if len(data):
        sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:-1] |= sign
        # U+0241 to U+024F lie in C9 81 - C9 8F; what follows in C9 is beyond
        odd[:-1] |= (data[:-1] == 0xC9) & (data[1:] > 0x8F)
    return ~odd


def plain_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of plain bytes only."""
    total = np.concatenate(([0], np.cumsum(~plain_bytes(data))))
    return total[offs[1:]] == total[offs[:-1]]


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Start bytes of the pre-tokens of plain rows laid end to end."""
    n = len(data)
    cls = CLASS[data]
    row_start = np.zeros(n + 1, bool)
    row_start[offs] = True
    row_start[n] = True
    start = np.ones(n, bool)
    start[1:] = cls[1:] != cls[:-1]
    start |= row_start[:n]
    space = cls == _SPACE
    # last character of a white-space run that something follows in the row
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~row_start[1:n]
    at = np.flatnonzero(last)
    start[at] = True
    start[at[data[at] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll
    q = np.flatnonzero((data == 39) & start)
    if len(q):
        pad = np.concatenate((data, np.zeros(3, np.uint8)))
        ends = np.concatenate((row_start, np.ones(3, bool)))
        a, b = pad[q + 1], pad[q + 2]
        inside = ~ends[q + 1]
        one = inside & ((a == 115) | (a == 116) | (a == 109) | (a == 100))
        two = inside & ~ends[q + 2] & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        for hit, size in ((one, 2), (two, 3)):
            p = q[hit]
            start[p + 1] = False
            rest = p + size
            start[rest[rest < n]] = True
    return np.flatnonzero(start)


def _byte_level() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


BYTE_LEVEL = _byte_level()


def byte_classes(config: dict) -> bool:
    """Whether the file's pre-tokens are those of :func:`pre_tokens`, each encoded by its BPE model alone."""
    pre, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    return (not config.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for runs laid end to end."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


class Encoder:
    """Ids of texts by the tokenizers library, each distinct pre-token encoded once while it is kept."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(raw)
        config = json.loads(raw)
        self.by_class = byte_classes(config)
        self.added = [t["content"].encode() for t in config.get("added_tokens") or [] if t["content"]]
        # added tokens that look beyond their own string leave no text to the table
        self.by_class &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in config.get("added_tokens") or [])
        self._clear()

    def _clear(self):
        self.known, self.word = np.zeros(0, _U), np.zeros(0, np.int64)
        self.text, self.pool = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.text_end, self.ids_end = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, words: list[bytes]):
        # the library's BPE model on byte-level characters: what its pipeline does with one pre-token
        split = self.tokenizer.model.tokenize
        text, ends = b"".join(words).decode("latin-1").translate(BYTE_LEVEL), list(accumulate(map(len, words)))
        ids = [[t.id for t in split(text[a:b])] for a, b in zip([0, *ends[:-1]], ends)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.ids_end) - 1
        self.pool = np.concatenate((self.pool, np.fromiter((i for w in ids for i in w), np.uint32, int(size.sum()))))
        self.ids_end = np.append(self.ids_end, self.ids_end[-1] + np.cumsum(size))
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(words), np.uint8)))
        self.text_end = np.append(self.text_end, self.text_end[-1] + np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        # both key lists are sorted: merge, do not sort again
        place = np.searchsorted(self.known, keys)
        self.known, self.word = np.insert(self.known, place, keys), np.insert(self.word, place, first + np.arange(len(keys)))

    def _find(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the kept word, whether it is kept) of distinct pre-tokens at ``begin`` in ``data``."""
        n = len(keys)
        if not len(self.known):
            return np.zeros(n, np.int64), np.zeros(n, bool)
        i = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        word = self.word[i]
        at = self.text_end[word]
        have = (self.known[i] == keys) & (self.text_end[word + 1] - at == size)
        k = np.flatnonzero(have)
        if len(k):
            same = self.text[_places(at[k], size[k])] == data[_places(begin[k], size[k])]
            have[k] = np.logical_and.reduceat(same, np.cumsum(size[k]) - size[k])
        return word, have

    def plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, ids per row) of plain rows; None where two different pre-tokens have one hash."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        starts = pre_tokens(data, offs)
        size = np.diff(np.append(starts, n))
        pos = np.arange(n) - np.repeat(starts, size)
        key = mix(np.add.reduceat(BYTE_VALUE[data] * powers(pos), starts))
        order = np.argsort(key)
        sorted_key = key[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        distinct = sorted_key[first]
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        where = order[first]
        begin, length = starts[where], size[where]
        # every pre-token against the one that stands for its hash
        if (length[which] != size).any() or (data[np.repeat(begin[which], size) + pos] != data).any():
            return None
        word, have = self._find(distinct, data, begin, length)
        if not have.all():
            if len(self.known) + int((~have).sum()) > CACHE:
                self._clear()
                have[:] = False
            new = np.flatnonzero(~have)
            raw = data.tobytes()
            word[new] = len(self.ids_end) - 1 + np.arange(len(new))
            self._learn(distinct[new], [raw[a:a + s] for a, s in zip(begin[new].tolist(), length[new].tolist())])
        at = self.ids_end[word]
        count = self.ids_end[word + 1] - at
        at, count = at[which], count[which]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[_places(at, count)]
        row = np.searchsorted(starts, offs)
        return ids, total[row[1:]] - total[row[:-1]]

    def _plain_rows(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if not self.by_class:
            return np.zeros(len(offs) - 1, bool)
        plain = plain_rows(data, offs)
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                plain[np.searchsorted(offs, at, side="right") - 1] = False
                at = raw.find(token, at + 1)
        return plain

    def rows(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids with the end id after each row, ids per row)."""
        data, offs = texts(col)
        plain = self._plain_rows(data, offs)
        size = np.diff(offs)
        got = self.plain(data[np.repeat(plain, size)], np.concatenate(([0], np.cumsum(size[plain]))))
        if got is None:
            plain[:] = False
            got = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, count = got
        counts = np.zeros(len(size), np.int64)
        counts[plain] = count
        parts: dict[int, np.ndarray] = {}
        odd = np.flatnonzero(~plain).tolist()
        if odd:
            raw = data.tobytes()
            for r, e in zip(odd, self.tokenizer.encode_batch([raw[offs[r]:offs[r + 1]].decode() for r in odd],
                                                             add_special_tokens=False)):
                parts[r] = np.array(e.ids, np.uint32)
                counts[r] = len(parts[r])
        end = np.concatenate(([0], np.cumsum(counts + 1)))
        out = np.full(end[-1], END_ID, np.uint32)
        fill = np.ones(end[-1], bool)
        fill[end[1:] - 1] = False
        for r, v in parts.items():
            out[end[r]:end[r + 1] - 1] = v
            fill[end[r]:end[r + 1]] = False
        out[fill] = ids
        return out, counts + 1


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, least: int = LEAST):
    """(rules, expansion lengths, symbols, symbols per document) of one shard.

    ``ends``: index after the last id of each document.  Symbols stay at the place of their first id;
    ``nxt`` and ``prv`` link the places that are left.  ``group`` numbers the pair that begins at a place,
    and a group's places are those it had when it came up: later it only loses some, for every new pair
    holds a nonterminal of the same round.
    """
    n = len(ids)
    bits = int(vocabulary + n // least + 1).bit_length()
    sym = np.append(ids.astype(np.int64), -1)
    nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
    nxt[n] = n
    last = np.zeros(n + 1, bool)
    last[ends - 1] = True
    last[n] = True
    group = np.full(n + 1, -1)
    mark = np.zeros(n + 1, bool)
    rank = np.full(n + 1, n + 1)
    none = np.zeros(0, np.int64)
    count, begin, size, place, first, second = none, none, none, none, none, none

    def come_up(at):
        """New groups of the pairs that begin at ``at``; a pair of fewer places than ``least`` never gets more."""
        nonlocal count, begin, size, place, first, second
        key = (sym[at] << bits) | sym[nxt[at]]
        low = len(at).bit_length()
        if 2 * bits + low < 63:
            key = (key << low) | np.arange(len(at))
            key.sort()
            order = key & ((1 << low) - 1)
            key >>= low
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        k = np.diff(edge)
        often = k >= least
        if not often.any():
            return
        edge, k = edge[:-1][often], k[often]
        where = at[order[_places(edge, k)]]
        group[where] = np.repeat(len(count) + np.arange(len(k)), k)
        begin = np.append(begin, len(place) + np.cumsum(k) - k)
        place = np.append(place, where)
        size, count = np.append(size, k), np.append(count, k)
        first, second = np.append(first, key[edge] >> bits), np.append(second, key[edge] & ((1 << bits) - 1))

    if n > 1:
        come_up(np.flatnonzero(~last[:n]))
    rules, n_rules = [], 0
    while len(count) and (top := int(count.max())) >= least:
        chosen = np.flatnonzero(count >= max(least, -(-top // 4)))
        chosen = chosen[np.argsort(-count[chosen], kind="stable")]
        k = size[chosen]
        at, own = place[_places(begin[chosen], k)], np.repeat(np.arange(len(chosen)), k)
        live = group[at] == chosen[own]
        at, own = at[live], own[live]
        # of overlapping pairs the more frequent one
        rank[at] = own
        before, after = rank[prv[at]], rank[nxt[at]]
        keep = (own < before) & (own < after)
        twin = np.flatnonzero((first[chosen] == second[chosen])[own] & (own <= before) & (own <= after))
        if len(twin):
            # a run of one symbol: every other place
            twin = twin[np.argsort(at[twin])]
            p, o = at[twin], own[twin]
            chain = np.concatenate(([False], (nxt[p[:-1]] == p[1:]) & (o[1:] == o[:-1])))
            i = np.arange(len(p))
            keep[twin] = (i - np.maximum.accumulate(np.where(chain, 0, i))) % 2 == 0
        rank[at] = n + 1
        at, own = at[keep], own[keep]
        good = np.bincount(own, minlength=len(chosen)) >= least
        if not good[0]:
            count[chosen[0]] = 0        # nothing overlaps the first pair but itself: it cannot pay for a rule
        use = good[own]
        at, own = at[use], own[use]
        if not len(at):
            continue
        name = np.cumsum(good) - 1
        rules.append(np.column_stack((first[chosen[good]], second[chosen[good]])))
        q = nxt[at]
        mark[q] = True
        left = prv[at]
        gone = np.concatenate((at, q, left[(left >= 0) & ~mark[left]]))
        mark[q] = False
        g = group[gone]
        count -= np.bincount(g[g >= 0], minlength=len(count))
        group[gone] = -1
        sym[at] = vocabulary + n_rules + name[own]
        sym[q] = -2
        last[at] = last[q]
        right = nxt[q]
        nxt[at] = right
        prv[right] = at
        n_rules += len(rules[-1])
        mark[at] = True
        left = prv[at]
        new = np.concatenate((at, left[(left >= 0) & ~mark[left]]))
        mark[at] = False
        come_up(new[~last[new]])
    stays = sym[:n] != -2
    length = np.ones(vocabulary + n_rules, np.int64)
    made = vocabulary
    for pairs in rules:
        length[made:made + len(pairs)] = length[pairs[:, 0]] + length[pairs[:, 1]]
        made += len(pairs)
    rules_ = np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32)
    return rules_, length[vocabulary:], sym[:n][stays].astype(np.uint32), \
        np.diff(np.concatenate(([0], np.flatnonzero(last[:n][stays]) + 1)))


def expand(sym: np.ndarray, rules: np.ndarray, vocabulary: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Ids of a run of symbols: the rules are expanded once, children before parents, then every symbol is copied."""
    n = len(rules)
    if not n:
        return sym
    kids = rules.astype(np.int64) - vocabulary                 # negative: an id
    if lengths is None:
        lengths = np.ones(n, np.int64)
        for k, (a, b) in enumerate(kids.tolist()):
            lengths[k] = (lengths[a] if a >= 0 else 1) + (lengths[b] if b >= 0 else 1)
    lengths = np.asarray(lengths, np.int64)
    # one pool: the ids of the vocabulary, then the expansions
    seen = np.zeros(vocabulary, bool)
    seen[rules[kids < 0]] = True
    seen[sym[sym < vocabulary]] = True
    used = np.flatnonzero(seen)
    start = np.concatenate((np.arange(len(used)), len(used) + np.cumsum(lengths) - lengths))
    size = np.concatenate((np.ones(len(used), np.int64), lengths))
    pool = np.empty(len(used) + int(lengths.sum()), np.uint32)
    pool[:len(used)] = used
    at = np.where(kids < 0, np.searchsorted(used, rules), len(used) + kids)
    done = np.zeros(len(size), bool)
    done[:len(used)] = True
    left = np.arange(n)
    while len(left):
        ready = done[at[left]].all(axis=1)
        now, left = left[ready], left[~ready]
        own = start[len(used) + now]
        for side in (0, 1):
            k = at[now, side]
            pool[_places(own, size[k])] = pool[_places(start[k], size[k])]
            own = own + size[k]
        done[len(used) + now] = True
    at = np.where(sym < vocabulary, np.searchsorted(used, sym), len(used) + sym.astype(np.int64) - vocabulary)
    return pool[_places(start[at], size[at])]


def id_at(sym: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int, place: int) -> int:
    """The id at ``place`` of a document's symbols, by expansion lengths alone."""
    ends = np.cumsum(np.where(sym < vocabulary, 1, lengths[np.maximum(sym.astype(np.int64) - vocabulary, 0)]
                              if len(lengths) else 1))
    k = int(np.searchsorted(ends, place, side="right"))
    place -= int(ends[k - 1]) if k else 0
    s = int(sym[k])
    while s >= vocabulary:
        a, b = (int(v) for v in rules[s - vocabulary])
        size = 1 if a < vocabulary else int(lengths[a - vocabulary])
        s, place = (a, place) if place < size else (b, place - size)
    return s


SHARD = ("task int, shard int, before long, doc_ids array<{kind}>, tokens array<long>, symbols_of array<long>, "
         "rules binary, lengths binary, symbols binary")


def write_shards(docs: DataFrame, tokenizer_path: str, shard_ids: int = SHARD_IDS, least: int = LEAST) -> str:
    """Encode, compress and write all documents in ascending doc_id order; returns the folder."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        vocabulary_file = f.read()
    sent = spark.sparkContext.broadcast(vocabulary_file)     # as large as its vocabulary
    tokenizer_key = hashlib.sha256(vocabulary_file).hexdigest()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # the table of known pre-tokens serves all tasks of a worker
        encoder = per_worker(f"encoder {tokenizer_key}", lambda: Encoder(sent.value))
        vocabulary = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        task, shard, before = TaskContext.get().partitionId(), 0, 0
        held, docs_, size = [], [], []
        n = 0

        def flush():
            ids, count = np.concatenate(held), np.concatenate(size)
            rules, lengths, sym, per = compress(ids, np.cumsum(count), vocabulary, least)
            return pa.record_batch([
                pa.array([task], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()),
                pa.array([pa.concat_arrays(docs_).to_pylist()], pa.list_(docs_[0].type)),
                pa.array([count.tolist()], pa.list_(pa.int64())), pa.array([per.tolist()], pa.list_(pa.int64())),
                *(pa.array([np.ascontiguousarray(x, dtype="<u4").tobytes()], pa.binary()) for x in (rules, lengths, sym))],
                names=["task", "shard", "before", "doc_ids", "tokens", "symbols_of", "rules", "lengths", "symbols"])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, count = encoder.rows(part.column("text"))
                # cut at document ends near every shard_ids ids
                edge = np.cumsum(count)
                a = 0
                while a < len(count):
                    room = shard_ids - n + (edge[a - 1] if a else 0)
                    b = max(a + 1, int(np.searchsorted(edge, room, side="right")))
                    lo, hi = (int(edge[a - 1]) if a else 0), int(edge[b - 1])
                    held.append(ids[lo:hi])
                    docs_.append(part.column("doc_id").slice(a, b - a))
                    size.append(count[a:b])
                    n += hi - lo
                    a = b
                    if n >= shard_ids or a < len(count):
                        yield flush()
                        shard, before, n = shard + 1, before + n, 0
                        held, docs_, size = [], [], []
        if held:
            yield flush()

    path = f"{shared_dir(spark)}/id-shards-{uuid.uuid4().hex[:12]}"
    rows = docs.select("doc_id", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")) \
            .mapInArrow(run, SHARD.format(kind=kind)).write.parquet(path)
    return path


def read_shards(spark, path: str, kind: str, vocabulary: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    shards = spark.read.schema(SHARD.format(kind=kind)).parquet(path)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rules, sym = (np.frombuffer(r[c], "<u4") for c in ("rules", "symbols"))
                lengths = np.frombuffer(r["lengths"], "<u4")
                ids = expand(sym, rules.reshape(-1, 2), vocabulary, lengths).astype("<u4")
                count = np.array(r["tokens"], np.int64)
                end = np.cumsum(count)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for e, c in zip(end.tolist(), count.tolist())]
                yield pa.record_batch([
                    pa.array([r["task"]] * len(count), pa.int32()),
                    pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array(r["before"] + end - count, pa.int64()), pa.array(count), pa.array(crc, pa.int64())],
                    names=["task", "doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per writing task: bounded by spark.sql.shuffle.partitions
    totals = shards.select("task", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")) \
        .groupBy("task").agg(F.sum("n").alias("n"))
    offsets = totals.select("task", F.expr(
        "coalesce(sum(n) over (order by task rows between unbounded preceding and 1 preceding), 0)").alias("offset"))
    return shards.mapInArrow(run, f"task int, doc_id {kind}, start long, n_tokens long, ids_crc32 long") \
        .join(F.broadcast(offsets), "task").select(
            "doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, shard_ids: int = SHARD_IDS, least: int = LEAST) -> DataFrame:
    """Write the documents' ids as Re-Pair shards and read them back, decoded."""
    from tokenizers import Tokenizer
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    path = write_shards(docs, tokenizer_path, shard_ids, least)
    return read_shards(docs.sparkSession, path, dict(docs.dtypes)["doc_id"], vocabulary)
