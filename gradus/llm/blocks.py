"""Words of many texts as flat numpy arrays.

Tasks get Arrow batches of texts. A batch is worked through in blocks of whole
texts of about ``BLOCK_BYTES``, so that memory follows the block (or the one text
that is longer), not the batch. Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8
bytes. A word's name is a 64-bit fingerprint of its bytes, the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def seeded(seed: int, n: int = 256) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    base = np.arange(1, n + 1, dtype=np.uint64) + _U64(seed * 1_000_003)
    return mix(base * _U64(_BASE)) | _U64(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.full(n, _BASE, np.uint64)
            self.down = np.full(n, inverse & _MASK, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


#: So many bytes are worked on at a time where a step makes several arrays of a block:
#: they stay in the processor's cache.
CACHED_BYTES = 1 << 15


def byte_sums(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running sums from which ``names_of`` takes the fingerprints of byte ranges."""
    up, _ = _POWERS.get(len(data) + 1)
    table = seeded(seed)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    held = np.empty(min(CACHED_BYTES, len(data)), np.uint64)
    for lo in range(0, len(data), CACHED_BYTES):
        hi = min(lo + CACHED_BYTES, len(data))
        terms = held[: hi - lo]
        np.take(table, data[lo:hi], out=terms, mode="clip")
        terms *= up[lo:hi]
        terms[:1] += sums[lo : lo + 1]
        np.cumsum(terms, out=sums[lo + 1 : hi + 1])
    return sums


def names_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte ranges ``[start, end)``."""
    _, down = _POWERS.get(len(sums))
    names = (sums[ends] - sums[starts]) * down[starts]
    return mix(names + (ends - starts).astype(np.uint64))


def range_names(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0
) -> np.ndarray:
    """Fingerprints of the byte ranges ``[start, end)``."""
    return names_of(byte_sums(data, seed), starts, ends)


@dataclass
class Block:
    """Texts ``lo`` to ``hi`` of a batch: bytes, and where each text begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words; index of each text's first word (one more
        entry at the end)."""
        n = len(self.data)
        solid = ~SPACE[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        before[edges] = False
        after[edges - 1] = False
        starts = np.flatnonzero(solid & ~before)
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes flagged lie in each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow array; null is empty."""
    texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    wide = texts.type in (pa.large_string(), pa.large_binary())
    kind = np.int64 if wide else np.int32
    _, at, held = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + n + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def owners(first: np.ndarray) -> np.ndarray:
    """For each item the text that holds it, given each text's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(names: np.ndarray, first: np.ndarray, k: int, seed: int = 0):
    """Fingerprints of all runs of ``k`` words inside one text, and where they
    start among the words."""
    n = len(names) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = seeded(seed + 17, 1)[0]
    out = names[:n].copy()
    for j in range(1, k):
        out *= factor
        out += names[j : j + n]
    text = owners(first)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(out[at]), at


def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed: first all low bytes, then all second ones, and
    so on. Before it stands how many there are."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    packed = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
    return len(values).to_bytes(8, "little") + packed


def unsqueezed(held: bytes) -> np.ndarray:
    n = int.from_bytes(held[:8], "little")
    if not n:
        return np.zeros(0, np.uint32)
    planes = pa.decompress(held[8:], 4 * n, codec="zstd", asbytes=True)
    planes = np.frombuffer(planes, np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()
