"""Byte n-grams of words or of running text, counted over all documents by language in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hasharrays
from . import textarrays as ta

FLUSH, RUNNING_BYTES = 1 << 20, 1 << 19
_EDGE = 0x20
#: Stands before a running text; no word holds it.
START = 0x0A


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, packed gram) for each byte of each word and the space after it; spaces stand before the word. Last byte lowest."""
    size = ends - starts
    of = np.repeat(np.arange(len(starts)), size + 1)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    gram = np.zeros(len(of), np.uint64)
    padded = np.append(data, np.uint8(_EDGE)) if len(data) else np.array([_EDGE], np.uint8)
    place, within = starts[of] + at, size[of]
    for k in range(order):
        inside = (at >= k) & (at - k < within)
        byte = padded[np.where(inside, place - k, len(data))]
        gram |= byte.astype(np.uint64) << np.uint64(8 * k)
    return of, gram


def distinct_words(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, index of the distinct word for each word, count) of the distinct (group, word)."""
    key = ta.mix(words + group.astype(np.uint64) * ta._G)
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, count


def running_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, packed gram) for each byte of the words of each text, a single space after each; ``START`` stands before the text. Last byte lowest."""
    size = ends - starts + 1
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    lead = np.zeros(len(doc), np.int64)
    lead[first] = order - 1
    out_at = np.cumsum(size + lead) - size
    total = int(out_at[-1] + size[-1]) if len(doc) else 0
    line = np.full(total, START, np.uint64)
    place = np.repeat(out_at - starts, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size))
    source = np.minimum(place - np.repeat(out_at - starts, size), len(data) - 1)
    line[place] = data[source]
    line[out_at + size - 1] = _EDGE
    gram = line.copy()
    for k in range(1, order):
        gram[k:] |= line[:-k] << np.uint64(8 * k)
    return np.repeat(doc, size), gram[place]


def count_grams(docs: DataFrame, lower: bool, separators: np.ndarray, order: int, running: bool = False) -> DataFrame:
    """(lang, gram, n) over the words of all texts or, with ``running``, over the texts; a task hands on each of its grams once for every FLUSH grams it met at most."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str | None, int] = {}
        keys, counts, held = [], [], 0
        hasharrays.forget()  # a new model is in the making

        def total() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.concatenate(keys), np.concatenate(counts)
            keys.clear(), counts.clear()
            order = np.argsort(k)
            k = k[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[first], np.add.reduceat(n[order], first).astype(np.int64)

        def rows(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            names = pa.array([x for x, _ in sorted(codes.items(), key=lambda x: x[1])], pa.string())
            lang = names.take(pa.array((k >> np.uint64(8 * order)).astype(np.int64)))
            gram = (k & np.uint64((1 << 8 * order) - 1)).astype(np.int64)
            return pa.RecordBatch.from_arrays([lang, pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

        for b in batches:
            lang = np.array([codes.setdefault(x, len(codes)) for x in b.column("lang").to_pylist()], np.int64)
            for base, data, at in ta.chunks(b.column("text"), lower, RUNNING_BYTES if running else ta.CHUNK_BYTES):
                starts, ends, doc = ta.spans(data, at, separators)
                if not len(starts):
                    continue
                group = lang[base + doc].astype(np.uint64) << np.uint64(8 * order)
                if running:
                    of_doc, gram = running_grams(data, starts, ends, doc, order)
                    key, n = np.unique(gram | (lang[base + of_doc].astype(np.uint64) << np.uint64(8 * order)), return_counts=True)
                else:
                    first, _, n = distinct_words(ta.hashes(data, starts, ends), group)
                    word, gram = grams_of(data, starts[first], ends[first], order)
                    key, inverse = np.unique(gram | group[first][word], return_inverse=True)
                    n = np.bincount(inverse, n[word])
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > 2 * FLUSH:
                    k, c = total()
                    held = len(k)
                    if held > FLUSH:
                        yield rows(k, c)
                        held = 0
                    else:
                        keys.append(k), counts.append(c)
        if held:
            yield rows(*total())
        pa.default_memory_pool().release_unused()

    return docs.select("lang", "text").mapInArrow(of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
