"""Vectorised text kernels for Arrow string columns, used inside Spark tasks.

Every function works on a block of whole texts at once. A block holds at most ``BLOCK`` bytes, or one longer
text, so a task needs about 60 bytes of memory for each byte of a block. Null texts count as empty.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither a letter nor a digit.
_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK + 1), base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def blocks(column, size: int = BLOCK):
    """Yields (first row, offsets, bytes) of runs of whole texts, of at most ``size`` bytes or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


class Words:
    """The words of a block: byte ranges, hashes of words or of their first bytes, and the first word of each text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = True, marks: bool = False):
        self.offsets, self.data = offsets, _LOWER[data] if lower else data
        inside = ~(_MARK if marks else _SPACE)[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the end
        self.counts = np.diff(self.first)
        self._sums = None

    def __len__(self):
        return len(self.starts)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_RANDOM[self.data] * powers(_BASE, n), out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * powers(_INVERSE, len(self.data) + 1)[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def head_hashes(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes; of shorter words, of the whole."""
        return self.span_hash(self.starts, np.minimum(self.ends, self.starts + k))

    def owner(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and how many each text has. A text with fewer words has its whole sequence as one."""
    h = words.hashes()
    n, counts = len(h), words.counts
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, np.uint64), made
    left = np.repeat(words.first[1:], counts) - np.arange(n)  # words from here to the text's end
    out = np.zeros(n, np.uint64)
    for j in range(k):
        at = np.minimum(np.arange(n) + j, n - 1)
        out = np.where(left > j, mix(out + np.uint64(0x9E3779B97F4A7C15) ^ h[at]), out)
    starts = np.zeros(n, bool)
    starts[words.first[:-1][counts > 0]] = True
    return out[(left >= k) | starts & (np.repeat(counts, counts) < k)], made


def shingle_sets(column, k: int = 5):
    """Yields the sorted distinct shingle hashes (uint64) of each text."""
    for _, offsets, data in blocks(column):
        values, made = shingles(Words(offsets, data), k)
        at = 0
        for m in made.tolist():
            part = np.sort(values[at : at + m])
            at += m
            yield part[np.r_[True, part[1:] != part[:-1]]] if m else part
