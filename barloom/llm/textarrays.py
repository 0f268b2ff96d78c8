"""Words, shingles and lines of many texts at once, as NumPy arrays over Arrow's string buffers.

A word is a run of bytes outside a set of separators. Its hash is a polynomial over its bytes modulo 2**64, taken from running sums, so
the cost does not depend on the number of words. Texts come in chunks of whole texts; one text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: Space and the controls from tab to carriage return, the separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters separates letter words; bytes of longer code points count as letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: The same, with digits in words.
NOT_WORD = NOT_LETTER.copy()
NOT_WORD[48:58] = False
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True

_M = 0xD1342543DE82EF95
_STEP, _BACK = np.uint64(_M), np.uint64(pow(_M, -1, 2**64))
_G = np.uint64(0x9E3779B97F4A7C15)
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _G)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= CHUNK_BYTES:
        if "up" not in _pow:
            _pow["up"], _pow["down"] = _powers_of(CHUNK_BYTES + 1)
        return _pow["up"], _pow["down"]
    return _powers_of(n + 1)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_STEP, _BACK):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        both.append(np.cumprod(a, dtype=np.uint64))
    return both[0], both[1]


def chunks(texts: pa.Array, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of whole texts; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the text) of the words of a chunk, in order; no word crosses texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the spans alone, one after the other; their starts and ends there; how far each was moved back)."""
    size = ends - starts
    end = np.cumsum(size)
    away = starts - (end - size)
    return data[np.arange(size.sum()) + np.repeat(away, size)], end - size, end, away


def hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The hashes of spans (starts, ends) of the same bytes, whose running sums are taken once."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return hasher(data)(starts, ends)


def ngrams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the runs of n words within one text."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = words[:k].copy()
    for j in range(1, n):
        h = h * _STEP + words[j : j + k]
    p = np.flatnonzero(doc[:k] == doc[n - 1 :])
    return p, mix(h[p])


def shingles(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every run of n words; a text of 1 to n-1 words is one shingle of all its words."""
    p, h = ngrams(words, doc, n)
    docs, found = [doc[p]], [h]
    if len(words):
        of, first, count = np.unique(doc, return_index=True, return_counts=True)
        for m in range(1, n):
            few = first[count == m]
            if len(few):
                g = words[few].copy()
                for j in range(1, m):
                    g = g * _STEP + words[few + j]
                docs.append(of[count == m])
                found.append(mix(g + np.uint64(m)))
    return np.concatenate(docs), np.concatenate(found)


def per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (group, value): whether the pair occurs twice or more, and whether it occurred before. Groups must ascend."""
    n = len(value)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = np.zeros(n, bool)
    same[1:] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, earlier = np.empty(n, bool), np.empty(n, bool)
    out[order], earlier[order] = twice, same
    return out, earlier
