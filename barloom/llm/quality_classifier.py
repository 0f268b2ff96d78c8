"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of logarithms of its statistics. Spark sums the vectors' first and second moments by class over all
labelled training rows, so the fit needs no sample. A class's covariance is shrunk towards the pooled one and then towards a multiple of
the identity; its Cholesky factor is computed once and kept in the model. A score is the logistic of the difference of the two classes'
Mahalanobis log-densities and log-priors.

Cases: a null text counts as empty; the empty text has a vector as any other, and so a score. A label that is neither 0 nor 1, and a label
without a document, are left out; a document with several labels counts once for each. With no labels of one of the classes the model is the
share of label 1 (0.5 without any label). Repeated rows are scored each. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import lean, materialize, table

NAMES = (
    "words", "word_length", "line_words", "symbols", "bars", "exclamations", "upper", "digits", "punctuation",
    "distinct", "adjacent", "repeated_5", "repeated_lines", "wide",
)
N = len(NAMES)
_IS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in {
    "symbols": b"#*$%&<>~^=@_\\{}[]", "bars": b"|", "exclamations": b"!?", "upper": bytes(range(65, 91)), "digits": b"0123456789",
    "punctuation": b".,;:", "letters": bytes(range(65, 91)) + bytes(range(97, 123)), "wide": bytes(range(0xC0, 256)), "tail": bytes(range(0x80, 0xC0)),
}.items()}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of N transformed statistics for each text."""
    rows = []
    for _, data, at in ta.chunks(texts):
        n = len(at) - 1
        starts, ends, doc = ta.spans(data, at)
        words = ta.hashes(data, starts, ends)
        n_words = np.bincount(doc, minlength=n).astype(float)
        chars = ta.per_text(~_IS["tail"][data], at).astype(float)
        count = {k: ta.per_text(_IS[k][data], at).astype(float) for k in _IS}
        l_starts, l_ends, l_doc = ta.spans(data, at, ta.NEWLINE)
        n_lines = np.bincount(l_doc, minlength=n).astype(float)
        _, seen_line = ta.repeated(l_doc, ta.hashes(data, l_starts, l_ends))
        _, seen_word = ta.repeated(doc, words)
        p5, h5 = ta.ngrams(words, doc, 5)
        _, seen_5 = ta.repeated(doc[p5], h5)
        beside = np.zeros(len(words), bool)
        beside[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        share = lambda x, of: x / np.maximum(of, 1)
        small = lambda x: np.log(x + 0.01)
        in_words = np.bincount(doc, (ends - starts), minlength=n)
        by = lambda d, m: np.bincount(d[m], minlength=n)
        rows.append(np.column_stack([
            np.log1p(n_words), np.log1p(share(in_words, n_words)), np.log1p(share(n_words, n_lines)),
            small(share(count["symbols"], chars)), small(share(count["bars"], n_words)), small(share(count["exclamations"], n_words)),
            small(share(count["upper"], count["letters"])), small(share(count["digits"], chars)), small(share(count["punctuation"], n_words)),
            # as against a text of this length: longer texts use fewer different words
            share(n_words - by(doc, seen_word), n_words) * np.log1p(n_words) ** 0.5,
            small(share(by(doc, beside), n_words)), small(share(by(doc[p5], seen_5), n_words)), small(share(by(l_doc, seen_line), n_lines)),
            small(share(count["wide"], chars)),
        ]))
    return np.concatenate(rows) if rows else np.zeros((0, N))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes; without both classes, only ``share``."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.share)
        a, b = (c - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True))
        return 1 / (1 + np.exp(np.clip(a - b, -700, 700)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 + N + N * N))
    for b in batches:
        y = b.column("y").to_numpy(zero_copy_only=False)
        x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, N)
        for k in (0, 1):
            z = x[y == k]
            total[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
    if total[:, 0].any():
        size = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size)), pa.array(np.tile(np.arange(size), 2)), pa.array(total.ravel())], ["y", "i", "v"])


def fit(labelled: DataFrame, shrink: float = 0.2, ridge: float = 0.02) -> Discriminant:
    """Fit on rows (f array<double>, y int); ``shrink`` towards the pooled covariance, ``ridge`` towards the identity.

    Tasks hand on 2 * (1 + N + N * N) sums each, whatever their input.
    """
    sums = labelled.mapInArrow(_moments, "y long, i long, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + N + N * N))
    for r in sums:
        total[r.y, r.i] = r.v
    n = total[:, 0]
    if not n.all():
        return Discriminant([], [], [], float(n[1] / n.sum()) if n.sum() else 0.5)
    means = [t[1 : N + 1] / t[0] for t in total]
    covs = [t[N + 1 :].reshape(N, N) / t[0] - np.outer(m, m) for t, m in zip(total, means, strict=True)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    factors, constants = [], []
    for k in (0, 1):
        s = (1 - shrink) * covs[k] + shrink * pooled
        s = (1 - ridge) * s + ridge * (np.trace(s) / N + 1e-9) * np.eye(N)
        chol = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(chol))
        constants.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(chol)).sum()))
    return Discriminant(means, factors, constants, float(n[1] / n.sum()))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(docs: DataFrame, with_id: bool = True) -> DataFrame:
    """(doc_id, f) for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column("text"))
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), f], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(of), "doc_id long, f array<double>")


def training_rows(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors of the documents that may be learnt from, with their labels."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("y"))
    known = known.where(~held_out(F.col("k")))
    return feats.join(known, feats["doc_id"] == known["k"]).select("f", "y")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Discriminant, DataFrame]:
    """The model, and the vectors of all documents as a written table."""
    feats = materialize(features(docs), "quality-features")
    return fit(training_rows(feats, labels)), feats


def score(feats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of (doc_id, f)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, N))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = feats.select("doc_id", "f").mapInArrow(lean(of), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text the classifier accepts."""
    model, _ = train(docs, labels)
    schema = docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(b.column("text"))) >= 0.5))

    return docs.mapInArrow(lean(of), schema)


def query(spark, sf_dir: str) -> DataFrame:
    model, feats = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(feats, model)
