"""Numpy helpers over the UTF-8 bytes of Arrow string batches.

Every function works on whole texts.  A batch is cut into slices of about
``SLICE_BYTES`` of text so that the temporary arrays stay small; one text is
never cut, so a task needs memory in proportion to its longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """64-bit finaliser (two multiply-xorshift rounds) on uint64 arrays."""
    z = z ^ (z >> _U(30))
    z = z * _U(0xBF58476D1CE4E5B9)
    z ^= z >> _U(27)
    z *= _U(0x94D049BB133111EB)
    z ^= z >> _U(31)
    return z


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers derived from ``salt``."""
    base = np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(salt)
    return mix(base) | _U(1)


BYTE_VALUE = seeds(256, 11)
# ASCII white space: space and \t \n \v \f \r
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = _U(0x2545F4914F6CDD1D)
_LO = 4096


def _cumpow(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POW_LO = _cumpow(_STEP, _LO)
with np.errstate(over="ignore"):
    _STEP_HI = _POW_LO[-1] * _STEP


def powers(pos: np.ndarray) -> np.ndarray:
    """The hash multiplier to the power of each position, by two small tables."""
    top = int(pos.max()) if len(pos) else 0
    if top < _LO:
        return _POW_LO[pos]
    hi = _cumpow(_STEP_HI, (top >> 12) + 1)
    return _POW_LO[pos & (_LO - 1)] * hi[pos >> 12]


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows with about ``limit`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    part = np.concatenate(([0], np.cumsum(size)[:-1])) // limit if len(size) else size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """White-space words of a slice: start byte, first word index per row, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lut: np.ndarray | None = None):
        n = len(data)
        self.data, self.offs = data, offs
        self.space = IS_SPACE[data]
        solid = ~self.space
        start = solid.copy()
        start[1:] &= self.space[:-1]
        first = offs[:-1][offs[:-1] < offs[1:]]
        start[first] = solid[first]
        self.starts = np.flatnonzero(start)
        self.row = np.searchsorted(self.starts, offs)          # word index range of each row
        self.count = np.diff(self.row)
        if not len(self.starts):
            self.hash = np.zeros(0, _U)
            return
        head = self.starts[0]
        pos = np.arange(head, n) - np.repeat(self.starts, np.diff(np.append(self.starts, n)))
        body = data[head:] if lut is None else lut[data[head:]]
        val = BYTE_VALUE[body] * powers(pos)
        val[self.space[head:]] = 0
        self.hash = mix(np.add.reduceat(val, self.starts - head))

    def shingles(self, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``k`` consecutive words and their index range per row.

        A row of fewer words, but not none, has its whole sequence as its one shingle.
        """
        h = self.hash if h is None else h
        n = len(h)
        c = seeds(k, 101)
        full = np.zeros(n, _U)
        if n >= k:
            for j in range(k):
                full[: n - k + 1] += h[j: n - k + 1 + j] * c[j]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        for r in short:
            a, b = self.row[r], self.row[r + 1]
            full[a] = (h[a:b] * c[: b - a]).sum(dtype=_U) + _U(b - a)
        take = np.minimum(self.count, np.maximum(self.count - k + 1, 1))
        at = np.concatenate(([0], np.cumsum(take)))
        idx = np.arange(at[-1]) + np.repeat(self.row[:-1] - at[:-1], take)
        return mix(full[idx]), at


def row_sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a per-byte (or per-word) array over each row's range."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def segment_hash(h: np.ndarray, starts: np.ndarray, salt: int = 0) -> np.ndarray:
    """Order-sensitive hash of each run of ``h`` that begins at ``starts`` (to the next start)."""
    if not len(starts):
        return np.zeros(0, _U)
    n, head = len(h), starts[0]
    pos = np.arange(head, n) - np.repeat(starts, np.diff(np.append(starts, n)))
    v = h[head:] if not salt else mix(h[head:] ^ _U(salt))
    return mix(np.add.reduceat(v * powers(pos), starts - head))
