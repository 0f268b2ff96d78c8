"""Quality rules: fixed counts, and bands of the perplexity under a modified Kneser-Ney model of each language.

Base counts follow ``[^\\x20\\x09-\\x0D]+`` words and \\n-split lines. A text fails the base if it has fewer than 20 words, or if more than 30 %
of its words lie in 8-word windows that occur twice or more in it.

Model. Words joined by single spaces are the running text. Spark counts its ``ORDER``-grams of bytes, over the spaces into earlier words, of all
documents by language, and from them the continuation counts of the lower orders, the counts of counts and each context's totals; no gram is
dropped. Modified Kneser-Ney with Chen and Goodman's three discounts for each language and order: what a context's discounts free goes to the lower order, down to
1/256, so a context's probabilities sum to 1. Log-probabilities and back-off weights are written as arrays sorted by the hash of (language, order,
gram), which the workers read from the shared folder.

Verdict. A text's value is the logarithm of its perplexity per byte. Quartiles of the values of all documents that pass the base give each
language a lower and an upper band, ``FENCE`` times the quartiles' distance outside the quartiles; a short text's values scatter more, so the bands widen by
``SHORT`` / sqrt(bytes). Texts outside are rejected.

Cases: a null text has no words and fails the base; its value is null. A null language is a language of its own, and so is the empty one. A language none of whose texts
passes the base has no bands. Repeated rows count and are judged each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hasharrays
from . import textarrays as ta
from .bytegrams import RUNNING_BYTES, START, count_grams, running_grams
from .shared import counted, discard, materialize, small, table

ORDER, FENCE, SHORT = 6, 3.0, 4.0
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_HEAD = (np.arange(256) & 0xC0) != 0x80
_U = np.uint64
_NULL = "null"


def _named(lang: F.Column) -> F.Column:
    """A name that is never null, and differs for null and every language."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(_NULL))


def _seed(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name)


def _key(seed: np.ndarray, gram: np.ndarray, order: int, back: bool) -> np.ndarray:
    return ta.mix(ta.mix(gram.astype(_U) + _U((2 * order + back) * int(ta._G) % 2**64)) ^ seed).view(np.int64)


class Model:
    """The written arrays of each order: ``p`` of grams and ``back`` of contexts, both as logarithms."""

    def __init__(self, paths: dict[int, str]) -> None:
        self.paths = paths

    def log_prob(self, seed: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Of the last byte of each gram after the others; lower orders are read only where a gram is new."""
        out, todo = np.zeros(len(gram)), np.arange(len(gram))
        for n in range(max(self.paths, default=0), 0, -1):
            if not len(todo):
                return out
            arrays, g, s = hasharrays.load(self.paths[n]), gram[todo] & _U((1 << 8 * n) - 1), seed[todo]
            at, hit = arrays.find(_key(s, g, n, False))
            out[todo[hit]] += arrays.values[at[hit]]
            todo, g, s = todo[~hit], g[~hit], s[~hit]
            at, hit = arrays.find(_key(s, g >> _U(8), n, True))
            out[todo[hit]] += arrays.values[at[hit]]
        out[todo] += np.log(1 / 256)
        return out


def _arrays(lang: str, rows: DataFrame, order: int) -> DataFrame:
    """(key, value) of a written order: its grams' log-probabilities and its contexts' back-off weights."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names = b.column(lang).dictionary_encode()
                seed = np.array([_seed(x) for x in names.dictionary.to_pylist()], _U)[names.indices.to_numpy()]
                gram, p, gamma = (b.column(k).to_numpy(zero_copy_only=False) for k in ("gram", "p", "back"))
                gram, some = gram.view(_U), ~np.isnan(gamma)
                key = np.concatenate([_key(seed, gram, order, False), _key(seed[some], gram[some] >> _U(8), order, True)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.log(np.concatenate([p, gamma[some]])).astype(np.float32))], ["key", "value"])

    return rows.select(lang, "gram", "p", "back").mapInArrow(of, "key long, value float")


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count, discount and write the model. A context has 256 grams at most, so its window is small; languages' discounts are joined by a checked broadcast."""
    rows = docs.select(_named(F.col("lang")).alias("lang"), "text")
    counts = {order: counted(count_grams(rows, False, ta.SPACE, order, running=True), f"grams-{order}")}
    for n in range(order - 1, 0, -1):
        short = F.expr(f"gram & {(1 << 8 * n) - 1}L")
        # before the start of a text there is nothing else than the start
        edge = F.shiftright("gram", 8 * (n - 1)) == START
        grams = counts[n + 1][0].groupBy("lang", short.alias("gram")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        counts[n] = counted(grams.select("lang", "gram", F.when(edge, F.col("all")).otherwise(F.col("kinds")).alias("n")), f"grams-{n}")
    paths, lower, n_lower = {}, None, 0
    for n in range(1, order + 1):
        grams, seen = counts[n]
        c = F.col("n")
        some = grams.where("n <= 4").groupBy("lang").agg(*(F.greatest(F.count_if(c == k), F.lit(1)).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        clip = lambda x, k: F.greatest(F.lit(0.1 * k), F.least(F.lit(0.9 * k), x)).alias(f"d{k}")
        some = some.select(F.col("lang"), *(clip(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), k) for k in (1, 2, 3)))
        discount = [F.coalesce(f"d{k}", F.lit(0.5 * k)) for k in (1, 2, 3)]
        context = Window.partitionBy("lang", "context")
        kinds = sum((d * F.count_if(c == k if k < 3 else c >= 3).over(context) for k, d in enumerate(discount, 1)), F.lit(0.0))
        rows = grams.withColumn("context", F.shiftright("gram", 8)).join(small(some, counts[1][1]["n"]), "lang", "left")  # order 1 has a row for each language at least
        rows = rows.withColumn("total", F.sum("n").over(context)).withColumn("gamma", kinds / F.col("total"))
        rows = rows.withColumn("back", F.when(F.row_number().over(context.orderBy("gram")) == 1, F.col("gamma")))  # once for each context
        own = (c - F.when(c == 1, discount[0]).when(c == 2, discount[1]).otherwise(discount[2])) / F.col("total")
        if lower is None:
            rows = rows.withColumn("p", own + F.col("gamma") / 256)
        else:
            rest = small(lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q")), n_lower)
            rows = rows.withColumn("own", own).withColumn("rest", F.expr(f"gram & {(1 << 8 * (n - 1)) - 1}L")).join(rest, ["lang", "rest"]).withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        before = lower
        lower, n_lower = materialize(rows.select("lang", "gram", "p", "back"), f"kneser-ney-{n}"), seen["n"]
        paths[n] = hasharrays.write(_arrays("lang", lower, n), "key", f"kneser-ney-arrays-{n}")
        discard(before, grams)
    discard(lower)
    return Model(paths)


SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, log_perplexity double"


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """The base counts and the logarithm of the perplexity per byte for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("name").dictionary_encode()
            seed = np.array([_seed(x) for x in names.dictionary.to_pylist()], _U)[names.indices.to_numpy()] if b.num_rows else np.zeros(0, _U)
            found = []
            for base, data, at in ta.chunks(b.column("text"), most=RUNNING_BYTES):
                n = len(at) - 1
                starts, ends, doc = ta.spans(data, at)
                words = ta.hashes(data, starts, ends)
                visible = ~ta.SPACE[data]
                l_starts, l_ends, l_doc = ta.spans(data, at, ta.NEWLINE)
                seen = np.concatenate([[0], np.cumsum(visible)])
                full = seen[l_ends] > seen[l_starts]
                l_doc = l_doc[full]
                _, again = ta.repeated(l_doc, ta.hashes(data, l_starts, l_ends)[full])
                place, h8 = ta.ngrams(words, doc, 8)
                twice, _ = ta.repeated(doc[place], h8)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, place[twice], 1)
                np.add.at(cover, place[twice] + 8, -1)
                covered = np.cumsum(cover)[:-1] > 0
                of_doc, gram = running_grams(data, starts, ends, doc, ORDER)
                n_bytes = np.bincount(of_doc, minlength=n)
                log_p = np.bincount(of_doc, model.log_prob(seed[base + of_doc], gram), minlength=n)
                found.append([
                    np.bincount(doc, minlength=n), ta.per_text(visible & _HEAD[data], at), ta.per_text(_SYMBOLS[data], at),
                    np.bincount(l_doc[again], minlength=n), np.bincount(doc[covered], minlength=n), n_bytes,
                    np.where(n_bytes > 0, -log_p / np.maximum(n_bytes, 1), np.nan),
                ])
            if found:
                *counts, value = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(value, from_pandas=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *columns], [x.split()[0] for x in SCHEMA.split(", ")])
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), _named(F.col("lang")).alias("name"), "text").mapInArrow(of, SCHEMA)


def judge(docs: DataFrame, fence: float = FENCE, short: float = SHORT) -> DataFrame:
    """All rows with their counts, base verdict, log-perplexity, its bands and the verdict."""
    docs = docs.withColumn("lang", F.col("lang").cast("string"))
    rows = materialize(measure(docs, train(docs)), "quality-measures")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    bands = rows.where("not base_failed").groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q"))
    bands, seen = counted(bands, "quality-bands")
    bands = small(bands, seen["n"])
    rows = rows.join(bands, rows["lang"].eqNullSafe(bands["of"]), "left")
    out = fence * (F.col("q")[1] - F.col("q")[0]) + F.lit(short) / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    rows = rows.withColumn("lower_band", F.col("q")[0] - out).withColumn("upper_band", F.col("q")[1] + out).drop("q", "of")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band")), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside)


def query(spark, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "lower_band", "upper_band"]
    return judge(table(spark, sf_dir, "documents")).select(columns)
