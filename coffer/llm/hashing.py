"""Word and shingle hashes of batches of texts, on flat numpy arrays.

A batch of texts becomes one byte array; words are found and hashed for all of them at once, so no Python code runs
per word. Words follow the task's rule (runs of bytes other than the six ASCII white-space characters) with A-Z in
lower case if asked; UTF-8 never uses those bytes inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about this many bytes; one longer text is a run of its own.
RUN_BYTES = 4 << 20
_WIDE = 40
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For words of letters and digits: all other ASCII characters separate.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[128:] = False
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of texts: ``text`` (index of the text in the batch), ``hash``, ``start`` and ``end`` (byte
    offsets in ``data``), in order; ``first`` and ``count`` are the texts of the run."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, lower: bool, space: np.ndarray = _SPACE):
        self.data, self.first, self.count = data, first, len(bounds) - 1
        n = len(data)
        word = ~space[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cut = bounds[:-1][bounds[:-1] < n]
        begins[cut] = word[cut]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        cut = bounds[1:][bounds[1:] > 0] - 1
        ends[cut] = word[cut]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(bounds, self.start, side="right") - 1 + first
        self.bounds = bounds
        self.hash = self._hashes(_LOWER[data] if lower else data)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(size <= _WIDE)
        where, left = self.start[at], size[at]
        prime = np.uint64(0x100000001B3)
        acc = out[at]
        step = 0
        # one pass per byte position, over the words that are that long
        while len(at):
            live = left > step
            if not live.all():
                out[at[~live]] = acc[~live]
                at, where, left, acc = at[live], where[live], left[live], acc[live]
                if not len(at):
                    break
            acc = (acc ^ data[where + step]) * prime
            step += 1
        for i in np.flatnonzero(size > _WIDE):
            raw = data[self.start[i]:self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        return mix(out)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``k`` words inside a text."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        at = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1:])
        acc = np.full(len(at), k, dtype=np.uint64)
        for j in range(k):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + self.hash[at + j])
        return at, acc

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of ``k`` words; a text of fewer words is one shingle as a whole."""
        at, acc = self.grams(k)
        text = self.text[at]
        found, begin, count = np.unique(self.text, return_index=True, return_counts=True)
        extra_t, extra_h = [], []
        for t, b, c in zip(found[count < k], begin[count < k], count[count < k]):
            h = np.array([c], dtype=np.uint64)
            for j in range(c):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[b + j: b + j + 1])
            extra_t.append(t)
            extra_h.append(h[0])
        if extra_t:
            text = np.concatenate([text, np.array(extra_t, dtype=text.dtype)])
            acc = np.concatenate([acc, np.array(extra_h, dtype=np.uint64)])
        return text, acc

    def sets(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(text, sorted distinct shingle hashes) of every text of the run, also of those without words."""
        text, h = self.shingles(k)
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        if len(h):
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            text, h = text[new], h[new]
        edge = np.searchsorted(text, np.arange(self.first, self.first + self.count + 1))
        for i in range(self.count):
            yield self.first + i, h[edge[i]: edge[i + 1]]


def runs(texts: pa.Array, lower: bool = True, space: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of an Arrow string array, in runs of whole texts; bytes in ``space`` separate. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + RUN_BYTES, side="right")) - 1)
        hi = min(hi, len(texts))
        yield Words(raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo], lo, lower, space)
        lo = hi
