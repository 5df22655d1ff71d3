"""64-bit hashes of the words of a batch of texts, and of runs of words, with numpy.

A word is hashed eight bytes at a time, each step mixed whole (no polynomial, whose differences cancel on structured words); long words by xxhash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_WINDOW = 1 << 20
_KEY = np.uint64(0x9E3779B97F4A7C15)
_WORDS = np.uint64(0xD6E8FEB86659FD93)
#: Words over so many bytes go to xxhash.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Words are runs of bytes that are no separators; A-Z count as a-z. Of each, the first ``longest`` bytes count."""

    def __init__(self, separators: bytes, longest: int | None = None):
        self.longest = longest
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.kept = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def _window(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of ``data``, which begins and ends between words; ``borders`` are where texts begin in it."""
        word = self.is_word[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inside = borders[(borders > 0) & (borders < len(data))]
        first[inside] = word[inside]
        last[inside - 1] = word[inside - 1]
        starts = np.flatnonzero(first)
        size = np.flatnonzero(last) - starts + 1
        if self.longest:
            size = np.minimum(size, self.longest)
        text = np.zeros(len(data) + 8, np.uint8)
        text[: len(data)] = self.lower[data]
        eight = np.ndarray(len(data) + 1, "<u8", text, strides=(1,))
        hashes = mix(size.astype(np.uint64) * _WORDS)
        todo = np.flatnonzero(size <= _LONG)
        at = 0
        while len(todo):
            block = eight[starts[todo] + at] & self.kept[np.minimum(size[todo] - at, 8)]
            hashes[todo] = mix(hashes[todo] * _KEY ^ mix(block + _KEY))
            at += 8
            todo = todo[size[todo] > at]
        for i in np.flatnonzero(size > _LONG).tolist():
            a = int(starts[i])
            hashes[i] = xxhash.xxh3_64_intdigest(text[a : a + int(size[i])].data, int(_LONG))
        return hashes, starts

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes of all texts one after the other, and where each text's begin, with the end of the last."""
        texts = texts.cast(pa.large_binary())
        _, offsets, buffer = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(texts) else np.zeros(0, np.uint8)
        borders = offsets - offsets[0]
        found, at, a = [], [], 0
        while a < len(data):
            b = min(a + _WINDOW, len(data))
            while b < len(data):  # back to a separator or a text's end; else on to the next
                gap = np.flatnonzero(~self.is_word[data[a:b]])
                i = np.searchsorted(borders, b, "right") - 1
                cut = max(a + int(gap[-1]) + 1 if len(gap) else a, int(borders[i]))
                if cut > a:
                    b = cut
                    break
                b = min(b + _WINDOW, len(data))
            lo, hi = np.searchsorted(borders, [a, b], "left")
            h, s = self._window(data[a:b], borders[lo:hi] - a)
            found.append(h)
            at.append(s + a)
            a = b
        if not found:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        return np.concatenate(found), np.searchsorted(np.concatenate(at), borders)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every ``n`` words in a row; it may lie across a text's border."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _WORDS + words[k : len(words) - n + 1 + k]
    return mix(out)
