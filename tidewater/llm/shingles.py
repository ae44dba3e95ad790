"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S1, _S2 = np.uint64(30), np.uint64(27)


class _Words(dict):
    """Hashes of words; forgets them all when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S1)) * _M2
    return x ^ (x >> _S2)


def word_hashes(text: str | None) -> np.ndarray:
    """Of the words of a text, A-Z lower-cased: runs of anything but ASCII white
    space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, k: int, short: bool = True) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles. A text of fewer
    words is one shingle (none if short is false), one of no words none."""
    h = word_hashes(text)
    if len(h) < k and (not short or not len(h)):
        return h[:0]
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        out = mixed((out + h[j : len(h) - size + 1 + j]) * _M1)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) > 1 else out
