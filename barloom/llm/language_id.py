"""Language identification: scripts narrow the candidates, Viterbi over words with a switching penalty labels spans.

Words are lower-case letter words. Learning counts, over all documents that may be learnt from, the byte 4-grams and the scripts of the
words of each language. A word's score under a language is the sum over its grams of the logarithm of the conditional probability of the last byte
given the three before, smoothed towards 1/256; all counted grams are kept.
A language is a candidate for a word if at least ``SHARE`` of its learnt words are of the word's script (the code point ranges of its first
letter); if there is no such language, all are candidates. The best path pays ``PENALTY`` for each change of language. The text's language is the
one whose spans hold most letters (code points that are letters; the first by name on a tie), and the score is its share of them. The grams' scores under all
languages are written as an array sorted by gram, which the workers read from the shared folder.

Cases: a text that is null or has no letter is ``und`` with score 0. Without anything to learn from all are ``und`` with score 0. Ids that are null
are not held out. Repeated rows are predicted each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hasharrays
from . import textarrays as ta
from .bytegrams import count_grams, distinct_words, grams_of
from .shared import discard, materialize, table

ORDER, SHARE, PENALTY, CELLS, SMOOTH = 4, 0.001, 12.0, 1 << 23, 2.0
_U = np.uint64
# The first code points of blocks, and the script from there on (0: none of these).
SCRIPTS = ("other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han")
RANGES = [
    (0x0000, 0), (0x0041, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7), (0x0E00, 8), (0x0E80, 0),
    (0x10A0, 9), (0x1100, 10), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 11), (0x3100, 0),
    (0x3400, 12), (0xA000, 0), (0xAC00, 10), (0xD800, 0), (0xF900, 12), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0x20000, 12), (0x30000, 0),
]
_FIRST, _SCRIPT = (np.array(x) for x in zip(*RANGES, strict=True))


def scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of the code point at each place."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[starts + k] for k in range(4))
    b, c, d = b & 0x3F, c & 0x3F, d & 0x3F
    point = np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c], (a & 0x07) << 18 | b << 12 | c << 6 | d)
    return _SCRIPT[np.searchsorted(_FIRST, point, "right") - 1]


def letters_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many code points of each word are letters."""
    sizes, plain = ends - starts, np.concatenate([[0], np.cumsum(data >= 0x80)])
    wide = np.flatnonzero(plain[ends] > plain[starts])
    out = sizes.copy()
    for w in wide:
        out[w] = sum(map(str.isalpha, data[starts[w] : ends[w]].tobytes().decode("utf-8", "replace")))
    return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """The written array of grams (a score for each language), the score of unseen grams, and which scripts each language writes."""

    def __init__(self, langs: list[str], path: str, floor: np.ndarray, writes: np.ndarray) -> None:
        self.langs, self.path, self.writes, self.floor = langs, path, writes, floor

    def arrays(self) -> hasharrays.HashArray:
        return hasharrays.load(self.path)

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each word: its score under each language."""
        word, gram = grams_of(data, starts, ends, ORDER)
        arrays = self.arrays()
        at, hit = arrays.find(gram.view(np.int64))
        each = np.where(hit[:, None], arrays.values[at], self.floor.astype(np.float32))
        first = np.cumsum(ends - starts + 1) - (ends - starts + 1)
        out = np.add.reduceat(each, first, axis=0)
        able = self.writes[scripts(data, starts)]
        able[~able.any(axis=1)] = True
        return np.where(able, out, out.min(axis=1, keepdims=True) - 1e4).astype(np.float32)


def train(docs: DataFrame) -> Model | None:
    """Counts of all rows with a language that are not held out; the languages and their counts of leading bytes reach the driver."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    grams = materialize(count_grams(rows, True, ta.NOT_LETTER, ORDER), "lang-grams")
    langs = sorted(r.lang for r in grams.select("lang").distinct().collect())
    if not langs:
        return None
    code = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, i)])
    context = F.shiftright("gram", 8)
    sums = grams.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
    kept = grams.withColumn("context", context).join(sums, ["lang", "context"])
    p = F.log((F.col("n") + SMOOTH / 256) / (F.col("total") + SMOOTH))
    floor = np.full(len(langs), np.log(SMOOTH / 256 / (50 + SMOOTH)))
    # a gram has one row for each language at most
    rows = kept.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(code, F.col("lang")).alias("lang"), p.alias("p")))).alias("of"))
    rows = rows.select("gram", F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda i: F.coalesce(F.element_at("of", i), F.lit(float(floor[0])))).cast("array<float>").alias("p"))
    path = hasharrays.write(rows, "gram", "lang-arrays")
    # words by script: the gram of a word's first byte has spaces only before it, so leading bytes tell the script's block
    lead = grams.where(F.shiftright("gram", 8) == 0x202020).select(F.element_at(code, F.col("lang")).alias("lang"), (F.col("gram") % 256).alias("byte"), "n").collect()
    second = grams.where(F.shiftright("gram", 16) == 0x2020).where(F.shiftright("gram", 8) % 256 >= 0xC0)
    second = second.select(F.element_at(code, F.col("lang")).alias("lang"), (F.col("gram") % 65536).alias("pair"), "n").collect()
    third = grams.where(F.shiftright("gram", 24) == 0x20).where(F.shiftright("gram", 16) % 256 >= 0xE0)
    third = third.groupBy("lang", (F.col("gram") % 2**24).alias("triple")).agg(F.sum("n").alias("n"))
    share = np.zeros((len(SCRIPTS), len(langs)))
    for r in lead:
        if r.byte < 0x80:
            share[scripts(np.array([r.byte], np.uint8), np.zeros(1, np.int64))[0], r.lang] += r.n
    for r in second:
        if r.pair >> 8 < 0xE0:
            share[scripts(np.array([r.pair >> 8, r.pair & 255], np.uint8), np.zeros(1, np.int64))[0], r.lang] += r.n
    blocks = third.select(F.element_at(code, F.col("lang")).alias("lang"), (F.floor(F.col("triple") / 256)).alias("block"), (F.col("triple") % 256).alias("low"), "n")
    for r in blocks.groupBy("lang", "block").agg(F.sum("n").alias("n"), F.min("low").alias("low")).collect():
        share[scripts(np.array([r.block >> 8, r.block & 255, r.low, 0x80], np.uint8), np.zeros(1, np.int64))[0], r.lang] += r.n
    share /= np.maximum(share.sum(axis=0), 1)
    discard(grams)
    return Model(langs, path, floor, share >= SHARE)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word; texts have their words in rows [first, first + count). All texts advance together, word by word."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    label = np.zeros(len(scores), np.int16)
    if not len(scores) or scores.shape[1] == 1:
        return label
    back = np.full(scores.shape, -1, np.int16)
    alive = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")
    value = scores[first[: alive[0]]].copy()
    for t in range(1, len(alive)):
        k = alive[t]
        value = value[:k]
        best = value.argmax(axis=1)
        switch = value[np.arange(k), best] - np.float32(penalty)
        stay = value >= switch[:, None]
        rows = first[:k] + t
        back[rows] = np.where(stay, -1, best[:, None])
        value = np.where(stay, value, switch[:, None])
        value -= value.max(axis=1, keepdims=True)
        value += scores[rows]
        # the value of a text that ends here is needed only for its last label
        ended = alive[t + 1] if t + 1 < len(alive) else 0
        label[rows[ended:]] = value[ended:].argmax(axis=1)
    short = first[alive[1] if len(alive) > 1 else 0 : alive[0]]
    label[short] = scores[short].argmax(axis=1)
    for t in range(len(alive) - 1, 0, -1):
        rows = first[: alive[t]] + t
        at = label[rows]
        came = back[rows, at]
        label[rows - 1] = np.where(came < 0, at, came)
    return label


def label(texts: pa.Array, model: Model, penalty: float = PENALTY) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, number of texts, index of the text, letters, language) of the words of some texts at a time."""
    held, size = [], 0

    def flush():
        base = held[0][0]
        n = held[-1][0] + held[-1][1] - base
        doc = np.concatenate([h[2] + h[0] - base for h in held])
        size, scores = (np.concatenate([h[k] for h in held]) for k in (3, 4))
        count = np.bincount(doc, minlength=n)
        return base, n, doc, size, viterbi(scores, np.cumsum(count) - count, count, penalty)

    for base, data, at in ta.chunks(texts, lower=True):
        starts, ends, doc = ta.spans(data, at, ta.NOT_LETTER)
        letters = np.zeros(0, np.int64)
        if len(starts):
            first, inverse, _ = distinct_words(ta.hashes(data, starts, ends), np.zeros(len(starts), np.int64))
            scores = model.scores(data, starts[first], ends[first])[inverse]
            letters = letters_of(data, starts[first], ends[first])[inverse]
        else:
            scores = np.zeros((0, len(model.langs)), np.float32)
        held.append((base, len(at) - 1, doc, letters, scores))
        size += scores.size
        if size > CELLS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def predict(docs: DataFrame, model: Model | None, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row; spans are (lang, words) runs in order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            pred, score, runs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
            for base, n, doc, letters, lang in label(texts, model, penalty) if model else ():
                k = len(model.langs)
                weight = np.bincount(doc * k + lang, letters, minlength=n * k).reshape(n, k)
                total, best = weight.sum(axis=1), weight.argmax(axis=1)
                for i in np.flatnonzero(total > 0):
                    pred[base + i], score[base + i] = model.langs[best[i]], weight[i, best[i]] / total[i]
                edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])])) if len(doc) else []
                for p, q in zip(edge, np.append(edge[1:], len(doc)), strict=True) if len(doc) else ():
                    runs[base + doc[p]].append({"lang": model.langs[lang[p]], "words": int(q - p)})
            for i in np.flatnonzero(score == 0):  # words of none but signs
                runs[i] = []
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred), pa.array(score), pa.array(runs, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, words: long>>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
