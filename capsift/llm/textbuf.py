"""Words of many texts at once, on the bytes of an Arrow column: bounds and hashes, without a Python object for each word.

A word's hash takes it eight bytes at a time. Each eight are mixed with a constant of their place before they are added, so it is no polynomial in the bytes, whose differences would cancel
modulo 2**64 for words such as Thue and Morse's. Two lanes, mixed by different constants, make 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_LANES = [(0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse modulo 2**64, up to the n-th at least."""
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(n + 1, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    one, two = _LANES[lane]
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(one)
    h ^= h >> np.uint64(29 + 4 * (lane == 0))
    h *= np.uint64(two)
    return h ^ (h >> np.uint64(33))


class Words:
    """data: all bytes; starts, ends: of each word; first: for each text its first word, and at the end the number of words."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        buf = column.buffers()[2]
        self.data = np.frombuffer(buf, dtype=np.uint8)[lo:hi] if buf is not None and hi > lo else np.zeros(0, dtype=np.uint8)
        self.offsets = offsets - lo
        inside = ~_IS_WS[self.data]
        cut = np.zeros(len(self.data) + 1, dtype=bool)  # a text begins here
        cut[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self, lanes: int = 1) -> list[np.ndarray]:
        """64 bits of each word's bytes for each lane; equal words have equal hashes in every task."""
        if not len(self):
            return [np.zeros(0, dtype=np.uint64) for _ in range(lanes)]
        size = self.ends - self.starts
        many = (size + 7) >> 3
        first = np.cumsum(many) - many
        single = len(size) == int(many.sum())
        no = np.zeros(len(size), dtype=np.int64) if single else np.arange(int(many.sum())) - np.repeat(first, many)
        at = self.starts if single else np.repeat(self.starts, many) + 8 * no
        left = size if single else np.repeat(size, many) - 8 * no
        padded = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
        eight = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))[at] & _MASKS[np.minimum(left, 8)]
        out = []
        for lane in range(lanes):
            # the place enters by a constant of its own, the lane by another finaliser
            h = mix(eight ^ mix((no + 1).astype(np.uint64) * np.uint64(_BASE), lane), lane)
            out.append(mix((h if single else np.add.reduceat(h, first)) + size.astype(np.uint64), lane))
        return out


def slices(batches, text: int = 0, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `size` bytes; no rows for empty batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = np.cumsum(sizes) // size
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + sizes[i] - 1 for each i, one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
