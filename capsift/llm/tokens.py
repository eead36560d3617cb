"""Token ids by the tokenizers library, word by word with a cache.

The tokenizers of this kind drop white space and never let a token cross it, so the ids of a text
are those of its white-space-separated pieces, one after the other. Ids of pieces seen before come
from a table that lives as long as the Python worker, found by a hash of 128 bits: 64 find the place, and the
other 64 must be equal, too, else the piece goes to the library by itself. New pieces go to it many in one call.
"""

from __future__ import annotations

import os

import numpy as np

from capsift.llm.textbuf import Words, ragged

END_ID = 1
#: A worker's table holds at most so many pieces (about 40 bytes each); then it starts anew.
KNOWN_PIECES = 3_000_000
_JOIN = 512
_encoders: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """`mark` is a special token of the vocabulary; the library splits a text there before all else."""

    def __init__(self, path: str, mark: str = "<|startoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark)
        self._forget()

    def _forget(self) -> None:
        self.known, self.sure = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)  # hashes, ascending, and their second halves
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.pool, self.used = np.zeros(1 << 16, dtype="<u4"), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and how many each has."""
        odd = [i for i, p in enumerate(pieces) if b"<|" in p or len(p) > 4096]
        alone = dict(zip(odd, self._ids([pieces[i].decode() for i in odd])))
        plain = [p.decode() for i, p in enumerate(pieces) if i not in alone]
        parts, sizes = [], []
        for ids in self._ids([self.mark.join(plain[i : i + _JOIN]) for i in range(0, len(plain), _JOIN)]):
            a = np.asarray(ids, dtype="<u4")
            marks = np.flatnonzero(a == self.mark_id)
            sizes.append(np.diff(np.concatenate(([-1], marks, [len(a)]))) - 1)
            parts.append(np.delete(a, marks))
        flat, n = (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
        if not alone:
            return flat, n
        ends, out, k = np.cumsum(n), [], 0
        for i in range(len(pieces)):
            if i in alone:
                out.append(np.asarray(alone[i], dtype="<u4"))
            else:
                out.append(flat[ends[k] - n[k] : ends[k]])
                k += 1
        return np.concatenate(out), np.array([len(x) for x in out])

    def _learn(self, hashes: np.ndarray, sure: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.known) + len(hashes) > KNOWN_PIECES and len(self.known):
            self._forget()
        ids, sizes = self.ids_of(pieces)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        put = np.searchsorted(self.known, hashes)
        self.known, self.sure = np.insert(self.known, put, hashes), np.insert(self.sure, put, sure)
        self.at, self.size = np.insert(self.at, put, at), np.insert(self.size, put, sizes)

    def encode(self, column, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column, one after the other, each text with the end id, and where each begins (and the last ends)."""
        w = Words(column)
        hashes, second = w.hashes(2)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        sure = second[first]
        place = self._find(unique)
        if (new := np.flatnonzero(place < 0)).size:
            self._learn(unique[new], sure[new], [w.word(i) for i in first[new]])
            place = self._find(unique)
            if (lost := np.flatnonzero(place < 0)).size:  # the table began anew
                self._learn(unique[lost], sure[lost], [w.word(i) for i in first[lost]])
                place = self._find(unique)
        odd = np.flatnonzero(second != self.sure[place][which])  # other words of the same first half
        at, size = self.at[place], self.size[place].astype(np.int64)
        if odd.size:
            ids, n = self.ids_of([w.word(i) for i in odd])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.pool[self.used : self.used + len(ids)] = ids  # behind what is used, for this call
            at, size = np.append(at, self.used + np.cumsum(n) - n), np.append(size, n)
            which = which.copy()
            which[odd] = len(unique) + np.arange(len(odd))
        sizes = size[which]
        end = 0 if end_id is None else 1
        ends = np.concatenate(([0], np.cumsum(sizes)))[w.first]  # in ids, without end ids
        bounds = ends + np.arange(len(ends)) * end
        ids = self.pool[ragged(at[which], sizes)]
        if end:
            ids = np.insert(ids, ends[1:], np.uint32(end_id))
        return ids.astype("<u4", copy=False), bounds

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
