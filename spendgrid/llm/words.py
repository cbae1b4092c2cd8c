"""Words and rolling hashes of whole batches of texts, on the bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # bytes of text handled at once; a longer text is a chunk of its own
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.cumprod(np.append(np.uint64(1), np.full(n, _BASE))), np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE))))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n + 1`` at least; those of long texts are not kept."""
    size = 1 << max(16, int(n).bit_length())
    return _powers(size) if size <= 2 * CHUNK_BYTES else _powers.__wrapped__(size)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread bits from any 64-bit values, one to one."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    z ^= y
    z *= np.uint64(0x94D049BB133111EB)
    y = z >> np.uint64(31)
    y ^= z
    return y


def chunks(texts: pa.Array, size: int = CHUNK_BYTES):
    """``(first, data, offsets)`` for runs of consecutive texts: their bytes and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset:texts.offset + n + 1].copy()
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if texts.null_count:
        texts = texts.fill_null("")
        _, raw_offsets, raw = texts.buffers()
        offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset:texts.offset + n + 1].copy()
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: differences of running polynomial sums.  Unequal ranges can be built that agree."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling_hash(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all ranges of ``length`` bytes, for choosing places.  Unequal ranges can be built that agree."""
    n = len(data) - length + 1
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[:n])


_STEP, _SEED = np.uint64(0x9FB21C651E98DF25), np.uint64(0x2545F4914F6CDD1D)
LONG_WORD = 256  # bytes; longer words are hashed one by one


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order; not linear in either, so that sums of powers cannot be made to agree."""
    return mixed(mixed(a + _SEED) * _STEP ^ b)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros after the end."""
    padded = np.ascontiguousarray(np.append(data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + _SEED)
    if not len(starts):
        return out
    eight = eights(data)
    at = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, int(size[at].max(initial=0)), 8):
        at = at[size[at] > k]
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - left))
        out[at] = joined(out[at], eight[starts[at] + k] & mask)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def run_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words: pairs, pairs of pairs and so on, then the parts that make up the length."""
    n = len(hashes) - length + 1
    whole, covered, now, size = None, 0, hashes, 1
    while size <= length:
        if length & size:
            part = now[covered:covered + n]
            whole, covered = part.copy() if whole is None else joined(whole, part), covered + size
        if 2 * size <= length:
            now = joined(now[:len(now) - size], now[size:])
        size *= 2
    return joined(whole, np.uint64(length))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: hash, document, byte range; ``edges`` are the word numbers where documents begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, space: np.ndarray = SPACE):
        self.n_docs = len(offsets) - 1
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~space[data]
        starts, ends = inside.copy(), inside.copy()
        if len(data):
            cuts = offsets[1:-1]
            before = np.zeros(len(data), bool)
            before[1:] = inside[:-1]
            before[cuts[cuts < len(data)]] = False
            starts &= ~before
            after = np.zeros(len(data), bool)
            after[:-1] = inside[1:]
            after[cuts[cuts > 0] - 1] = False
            ends &= ~after
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.edges = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.edges)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.hash = word_hash(data, self.starts, self.ends)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``length`` words within a document."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n - length + 1] == self.doc[length - 1:])
        return at, run_hash(self.hash, length)[at]
