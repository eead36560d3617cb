"""A wavelet matrix over token ids, and its file: bit-planes with rank and select, each plane compressed by itself.

File: b"WVM1", the header's length (4 bytes, little-endian), a JSON header, then zstd frames. The
header has n (tokens), levels, zeros (of each plane), documents, and for each frame its name,
place and size. Frames: `ids` (int64 document ids), `null` (1 where the id is null), `count` (int64
tokens of each document), and for each plane `bits<l>` (n bits, least significant first, in 64-bit words)
and `ones<l>` (uint32: ones before each word). A reader fetches the frames that a question needs.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVM1"


def build(tokens: np.ndarray, doc_ids: list, counts: np.ndarray, level: int = 1) -> bytes:
    """One file's bytes. tokens: those of all documents in order; counts: tokens of each document."""
    tokens = np.asarray(tokens, dtype=np.uint32)
    levels = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    frames: list[tuple[str, bytes]] = [
        ("ids", np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes()),
        ("null", np.array([i is None for i in doc_ids], dtype="u1").tobytes()),
        ("count", np.asarray(counts, dtype="<i8").tobytes()),
    ]
    zeros, rest = [], tokens
    for k in range(levels):
        bit = ((rest >> np.uint32(levels - 1 - k)) & np.uint32(1)).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        packed = np.concatenate((packed, np.zeros(-len(packed) % 8, dtype=np.uint8)))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed.view("<u8")), dtype=np.int64)))
        frames += [(f"bits{k}", packed.tobytes()), (f"ones{k}", ones.astype("<u4").tobytes())]
        zeros.append(int(len(bit) - ones[-1]))
        rest = np.concatenate((rest[~bit], rest[bit]))
    pack = zstandard.ZstdCompressor(level=level)
    at, body, where = 0, [], {}
    for name, raw in frames:
        body.append(pack.compress(raw))
        where[name] = (at, len(body[-1]), len(raw))
        at += len(body[-1])
    header = json.dumps({"n": len(tokens), "levels": levels, "zeros": zeros, "documents": len(doc_ids), "frames": where}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(body)


class WaveletMatrix:
    """Questions to one file; `data` is its bytes or anything that slices like bytes (a memory map)."""

    def __init__(self, data):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", bytes(data[4:8]))
        head = json.loads(bytes(data[8 : 8 + size]))
        self.n, self.levels, self.zeros, self.documents = head["n"], head["levels"], head["zeros"], head["documents"]
        self._data, self._frames, self._base = data, head["frames"], 8 + size
        self.frame = lru_cache(maxsize=None)(self._frame)

    def _frame(self, name: str) -> bytes:
        at, packed, raw = self._frames[name]
        return zstandard.ZstdDecompressor().decompress(bytes(self._data[self._base + at : self._base + at + packed]), max_output_size=max(raw, 1)) if raw else b""

    def doc_ids(self) -> list:
        ids, null = np.frombuffer(self.frame("ids"), "<i8").tolist(), self.frame("null")
        return [None if x else i for i, x in zip(ids, null)]

    def counts(self) -> np.ndarray:
        return np.frombuffer(self.frame("count"), "<i8")

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.frame(f"bits{k}"), "<u8"), np.frombuffer(self.frame(f"ones{k}"), "<u4")

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        words, before = self._plane(k)
        w, r = divmod(i, 64)
        return int(before[w]) + (int(words[w]) & ((1 << r) - 1)).bit_count() if r else int(before[w])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for k in range(self.levels):
            words, _ = self._plane(k)
            bit = int(words[i // 64]) >> (i % 64) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before place `end` stand below the last plane."""
        a, b = 0, end
        for k in range(self.levels):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (self.levels - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token before place `end`."""
        if token < 0 or token >> self.levels:
            return 0
        a, b = self._range(token, min(max(end, 0), self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, k: int, bit: int, nth: int) -> int:
        """The place of the nth (from 0) bit of this kind in plane k."""
        words, before = self._plane(k)
        marks = before.astype(np.int64) if bit else np.arange(len(before), dtype=np.int64) * 64 - before
        w = int(np.searchsorted(marks, nth, side="right")) - 1
        word, left = int(words[w]), nth - int(marks[w])
        for r in range(64):
            if (word >> r & 1) == bit:
                if not left:
                    return w * 64 + r
                left -= 1
        raise IndexError(nth)

    def select(self, token: int, nth: int) -> int:
        """The place of the token's nth occurrence (from 0)."""
        if token < 0 or token >> self.levels or not 0 <= nth < self.count(token):
            raise IndexError(nth)
        i = self._range(token, self.n)[0] + nth
        for k in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - k) & 1
            i = self._find(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, i) for i in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens, from the last plane to the first."""
        out = np.zeros(self.n, dtype="<u4")
        for k in reversed(range(self.levels)):
            bit = np.unpackbits(np.frombuffer(self.frame(f"bits{k}"), np.uint8), bitorder="little", count=self.n).view(bool)
            up = np.empty_like(out)
            up[~bit], up[bit] = out[: self.zeros[k]], out[self.zeros[k] :] | np.uint32(1 << (self.levels - 1 - k))
            out = up
        return out
