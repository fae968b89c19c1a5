"""Words of whole texts as 64-bit hashes, by array operations over the UTF-8 bytes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z.  Every
byte of a multi-byte character is above 0x7F, so splitting bytes splits characters alike.
A word's hash is a polynomial over its bytes modulo 2**64 (from one running sum over the
chunk), then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser, a bijection on 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Tokeniser:
    """``punctuation``: runs of ASCII punctuation are tokens of their own, as in word-punct splitting."""

    def __init__(self, punctuation: bool = False, chunk: int = 1 << 20):
        self.chunk = chunk
        table = mix(np.arange(1, 257, dtype=U) * U(_BASE))
        table[65:91] = table[97:123]
        self.table = table
        kind = np.ones(256, np.uint8)
        kind[[32, *range(9, 14)]] = 0
        if punctuation:
            kind[[b for b in range(33, 127) if not chr(b).isalnum() and b != 95]] = 2
        self.kind = kind
        self.powers(chunk + (1 << 16))

    def powers(self, n: int) -> None:
        self.up = np.cumprod(np.full(n, _BASE, U))
        self.down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), U))

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, text after the last, hashes of the words, words of each text); null is empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if not len(texts):
            return
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + self.chunk, "right")) - 1)
            h, counts = self.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield lo, hi, h, counts
            lo = hi

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
        if n > len(self.up):
            self.powers(n)
        kind = self.kind[data]
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = 0
        after[offsets[1:][full] - 1] = 0
        start = np.flatnonzero((kind != before) & (kind > 0))
        end = np.flatnonzero((kind != after) & (kind > 0))
        total = self.table[data]
        total *= self.up[:n]
        np.cumsum(total, out=total)
        h = total[end]
        inner = start > 0
        h[inner] -= total[start[inner] - 1]
        h *= self.down[start]
        h += (end - start + 1).astype(U) * U(0xD6E8FEB86659FD93)
        return mix(h), np.diff(np.searchsorted(start, offsets))


def grams(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width`` words from each word on, and where they stay within one text."""
    if len(h) < width:
        return np.zeros(0, U), np.zeros(0, bool)
    g = np.zeros(len(h) - width + 1, U)
    for k in range(width):
        g = g * U(0xC2B2AE3D27D4EB4F) + h[k : len(h) - width + 1 + k]
    ends = np.repeat(np.cumsum(counts), counts)[: len(g)]
    return mix(g + U(width)), np.arange(len(g)) + width <= ends


def shingle_sets(h: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of fewer words, one for all of them."""
    g, inside = grams(h, counts, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(g[at : at + n - width + 1]))
        elif n:
            out.append(mix(np.add.reduce(mix(h[at : at + n] + np.arange(1, n + 1, dtype=U)), keepdims=True) + U(n)))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out
