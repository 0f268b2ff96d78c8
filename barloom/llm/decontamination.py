"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-case words (ASCII letters and digits and all longer code points; the rest separates). A document is contaminated by
an item of n words if some stretch of it is within floor(``rate`` * n) word edits (insertion, deletion, substitution) of the item.

Windows. A stretch within k edits keeps one of any k+1 equal pieces of the item whole, so it holds a run of q = min(3, n // (k + 1)) words
of the item in place. Every such run in a document proposes one window of the item's size, aligned by the run's place in the item. Nothing
is lost by this, and clean documents propose almost no window.

Search. The random walk of CGK turns a window into 3n symbols: each step emits the symbol under the pointer, and a random bit of (step,
symbol) moves it on. Words are the symbols, so sequences at a small edit distance differ in few places. Each table samples ``SYMBOLS``
places; ``WALKS`` walks of ``TABLES`` tables each are looked up among the items of the same size. What is found is verified by the exact
edit distance of the item to the best stretch around the window.

Items are dealt by hash into blocks of about ``BLOCK``. Spark builds each block's index in a task of its own and writes it to the shared folder. All documents
pass once, without a shuffle; a task looks each batch up in one block after the other, read from the folder, so the driver never holds an index, and the tasks
never hold more than one block's index. Cases: a null text counts as empty; documents and items without words match nothing; an item
whose id is null counts but is not listed; repeated rows and items count each; no items: nothing is contaminated. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import lean, materialize, table

RATE, WALKS, TABLES, SYMBOLS, BLOCK, HELD = 0.2, 24, 4, 4, 20_000, 128 << 20
_U = np.uint64


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(index of the first text, number of texts, hashes, index of the text) by chunk."""
    for base, data, at in ta.chunks(texts, lower=True):
        starts, ends, doc = ta.spans(data, at, ta.NOT_WORD)
        yield base, len(at) - 1, ta.hashes(data, starts, ends), doc


def distance(item: list[int], stretch: list[int]) -> int:
    """The least edit distance of the item to a part of the stretch, by bit-parallel columns."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        where[w] |= 1 << i
    up, down, score, best = full, 0, n, n
    for w in stretch:
        eq = where.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        h_up, h_down = (down | ~(d | up)) & full, up & d
        score += bool(h_up & top) - bool(h_down & top)
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full
        up, down = (h_down | ~(d | h_up)) & full, h_up & d
        best = min(best, score)
    return best


class Index:
    """The words, runs and tables of one block of items; a plain value that tasks receive."""

    def __init__(self, ids: list[int | None], texts: list[str | None], rate: float = RATE) -> None:
        hashed = [[] for _ in texts]
        for base, _, h, doc in words_of(pa.array(texts, pa.string())):
            for k in np.unique(doc):
                hashed[base + k] = h[doc == k]
        keep = [i for i, h in enumerate(hashed) if len(h)]
        self.ids, self.words = [ids[i] for i in keep], [hashed[i] for i in keep]
        self.edits = [int(rate * len(w) + 1e-9) for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.runs = {}
        by = defaultdict(list)
        for i, (w, k) in enumerate(zip(self.words, self.edits, strict=True)):
            by[min(3, len(w) // (k + 1))].append(i)
        for q, items in by.items():
            found = []
            for i in items:
                p, h = ta.ngrams(self.words[i], np.zeros(len(self.words[i]), np.int64), q)
                found.append((h, p, np.full(len(p), self.sizes[i])))
            h, p, n = (np.concatenate(x) for x in zip(*found, strict=True))
            # one entry for each (run, place, size): windows don't depend on the item itself
            keep = np.unique(np.stack([h.view(np.int64), p, n]), axis=1)
            h, order = keep[0].view(_U), np.argsort(keep[0].view(_U), kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(h >> _U(42)).astype(np.int64)] = True
            self.runs[q] = (np.packbits(bits), h[order], keep[1][order], keep[2][order])
        if self.words:
            key, self.width = self._keys(*self._matrix(self.words))
            order = np.argsort(key.ravel(), kind="stable")
            self.table, self.of = key.ravel()[order], (order % len(self.words)).astype(np.int32)

    @staticmethod
    def _matrix(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(w) for w in words])
        m = np.zeros((len(words), n.max()), _U)
        for i, w in enumerate(words):
            m[i, : len(w)] = w
        return m, n

    def _keys(self, m: np.ndarray, n: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """A key of each table (rows) for each sequence (columns); n: words there are, size: the item's size that the window has."""
        size, rows, keys = n if size is None else size, np.arange(len(m)), []
        steps = 3 * int(size.max())
        places = (np.random.default_rng(7).random((WALKS, TABLES, SYMBOLS))[:, :, :, None] * (3 * size)[None, None, None, :]).astype(np.int64)
        for walk in range(WALKS):
            at, out = np.zeros(len(m), np.int64), np.zeros((len(m), steps), _U)
            for j in range(steps):
                live = at < n
                symbol = np.where(live, m[rows, np.minimum(at, m.shape[1] - 1)], _U(0))
                out[:, j] = symbol
                at += (ta.mix(symbol + _U((walk * 1_000_003 + j) * int(ta._G) % 2**64)) & _U(1)).astype(np.int64)
            for t in range(TABLES):
                key = size.astype(_U) * ta._G + _U(walk * TABLES + t)
                for s in range(SYMBOLS):
                    key = ta.mix(key * ta._STEP + out[rows, places[walk, t, s]])
                keys.append(key)
        return np.stack(keys), m.shape[1]

    def windows(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows of (start, size): starts count from the first word of the chunk and may lie before the text."""
        found = []
        for q, (bits, h, place, size) in self.runs.items():
            p, g = ta.ngrams(words, doc, q)
            slot = (g >> _U(42)).astype(np.int64)
            maybe = np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            low, high = np.searchsorted(h, g[maybe], "left"), np.searchsorted(h, g[maybe], "right")
            many = high - low
            entry = np.repeat(low, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
            at = np.repeat(p[maybe], many)
            found.append(np.stack([at - place[entry], size[entry], doc[at]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def search(self, texts: pa.Array) -> dict[int, dict[int, int]]:
        """For each contaminated text, its items' positions in the block with the least distances found."""
        found: dict[int, dict[int, int]] = defaultdict(dict)
        if not self.words:
            return found
        rows, stretches, sizes, edges = [], [], [], []
        most = np.zeros(int(self.sizes.max()) + 1, np.int64)
        np.maximum.at(most, self.sizes, self.edits)
        for base, n, words, doc in words_of(texts):
            ends = np.searchsorted(doc, np.arange(n + 1))
            for start, size, d in self.windows(words, doc):
                low, high = max(start, ends[d]), min(start + size, ends[d + 1])
                rows.append(base + d)
                stretches.append(words[low:high])
                sizes.append(size)
                edges.append(words[max(ends[d], start - most[size]) : min(ends[d + 1], start + size + most[size])])
        for i in range(0, len(rows), 4096):
            m, n = self._matrix(stretches[i : i + 4096])
            key, _ = self._keys(m, n, np.array(sizes[i : i + 4096]))
            low, high = np.searchsorted(self.table, key, "left"), np.searchsorted(self.table, key, "right")
            pairs = {(int(w), int(x)) for t, w in zip(*np.nonzero(high > low), strict=True) for x in self.of[low[t, w] : high[t, w]]}
            for w, x in sorted(pairs):
                d = distance(self.words[x].tolist(), edges[i + w].tolist())
                if d <= self.edits[x]:
                    old = found[rows[i + w]].get(x, d)
                    found[rows[i + w]][x] = min(old, d)
        return found


class Blocks:
    """The written indexes. With a single one a worker reads it once and keeps it; with more, each is read once for as many texts as ``HELD`` bytes hold."""

    _last: tuple | None = None

    def __init__(self, files: list[str]) -> None:
        self.files = files

    def __iter__(self) -> Iterator[Index]:
        if len(self.files) == 1 and Blocks._last and Blocks._last[0] == self.files[0]:
            yield from Blocks._last[1]
            return
        for path in self.files:
            files, local = fs.FileSystem.from_uri(path)
            with files.open_input_file(local) as f:
                parts = pq.ParquetFile(f)
                for b in parts.iter_batches(batch_size=1):
                    found = [pickle.loads(x) for x in b.column(0).to_pylist()]
                    if len(self.files) == 1 and parts.metadata.num_rows == 1:
                        Blocks._last = (path, found)
                    yield from found

    def search(self, batches: Iterator[pa.RecordBatch], held: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[tuple[list, dict[int, dict[int, int]]]]]]:
        """Each batch with what each block finds in its texts: blocks outside, the held batches inside. A single file is at hand for every batch, so none is held."""
        held = held if held is not None else HELD if len(self.files) > 1 else 0
        waiting, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            size += b.nbytes
            if size >= held:
                yield from self._all(waiting)
                waiting, size = [], 0
        if waiting:
            yield from self._all(waiting)

    def _all(self, waiting: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[list, dict[int, dict[int, int]]]]]]:
        found: list[list] = [[] for _ in waiting]
        for index in self:
            for k, b in enumerate(waiting):
                if hits := index.search(b.column("text")):
                    found[k].append((index.ids, hits))
        yield from zip(waiting, found, strict=True)


def indexes(items: DataFrame, rate: float = RATE, block: int = BLOCK) -> Blocks:
    """The items' indexes, a block of about ``block`` items each, in the shared folder."""
    items = items.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    n = max(1, math.ceil(items.count() / block))

    def build(rows):
        ids = [None if x is None or x != x else int(x) for x in rows["item_id"]]
        return rows.iloc[:1].assign(index=[pickle.dumps(Index(ids, list(rows["text"]), rate))])[["index"]]

    built = items.select(F.col("item_id").cast("string").alias("item_id"), "text", F.pmod(F.xxhash64("text"), F.lit(n)).alias("block"))
    return Blocks(sorted(materialize(built.groupBy("block").applyInPandas(build, "index binary"), "decontamination-indexes").inputFiles()))


def find(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """(doc_id, contaminated, item_ids, least_edits) for each row; item_ids ascend, least_edits is null if there are none."""
    blocks = indexes(items, rate, block)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in blocks.search(batches):
            ids: list = [[] for _ in range(b.num_rows)]
            least: list = [None] * b.num_rows
            for names, hits in found:
                for row, of_row in hits.items():
                    ids[row] += [names[x] for x in of_row if names[x] is not None]
                    least[row] = min([*of_row.values(), *([] if least[row] is None else [least[row]])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(sorted, ids), pa.list_(pa.int64())), pa.array(least, pa.int64())], ["doc_id", "item_ids", "least_edits"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(of), "doc_id long, item_ids array<long>, least_edits long")
    return out.select("doc_id", F.col("least_edits").isNotNull().alias("contaminated"), "item_ids", "least_edits")


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all their columns, that no item contaminates."""
    blocks = indexes(items, rate, block)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in blocks.search(batches):
            keep = np.ones(b.num_rows, bool)
            for _, hits in found:
                keep[list(hits)] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(of), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
