"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

Channel. A disguised stretch is a token (a run of non-space) with a look-alike sign before its last letter, with joints between its letters, or with a letter three times in a row; or
at least three tokens of one letter each. Each byte of it opens its alternatives: a letter is itself, or left out where it repeats the one before; a
look-alike is one of its letters, left out, or the end of a word; any other sign is left out or the end of a word. ``COSTS`` are the channel's negative log-probabilities.
A byte model of order ``ORDER`` of the words of all documents, with all counted grams, is the source. Viterbi finds the likeliest reading of each distinct stretch:
states are the last three bytes, all stretches of a batch advance together, and the best way into each state is kept. Stretches of more than ``PIECE`` bytes are read in pieces of it, one after the other.

Score. Words of the restored, lower-case text count as wholes and by their beginnings of ``BEGIN`` code points, so that a stem is known in words that were never seen. Spark counts,
for each of these features, the learnt documents of either label that hold it. A word's evidence is the largest log-ratio of its features, less ``DOUBT``
standard errors. The document's evidence (its strongest word, how many words have any, their sum, their share, its length) goes through a logistic regression. When the
regression is learnt, each document's own label is left out of the counts that make its evidence.

Labels may be sampled: ``EXAMPLES`` labelled rows at about most, by a hash of the id, are learnt from and broadcast. All else covers all rows.

Cases: a null text counts as empty; the empty text has no evidence, and a score. A label that is neither 0 nor 1, and a label without a document, are left out; several labels of a
document count each. Without both labels the score is the share of label 1 among them (0 without any). Null ids are not held out. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hasharrays
from . import textarrays as ta
from .bytegrams import count_grams
from .shared import counted, discard, materialize, table

ORDER, SMOOTH, PIECE, AT_ONCE = 4, 2.0, 256, 20_000
BEGIN, LEAST, TIMES, DOUBT, CUT = (3, 4, 5, 6, 7), 3, 2.0, 1.0, 1.0
EXAMPLES, FLUSH = 200_000, 1 << 20
#: Costs of a look-alike read as a letter, left out, and as an end; of a sign left out; of a space left out; of a repeated letter left out.
COSTS = {"swap": 1.0, "drop": 4.0, "break": 2.0, "joint": 1.5, "space": 1.0, "repeat": 1.0}
# Which letters a sign stands for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "*": "aeiou",
}
_JOINTS = b".-_~^,"
_LETTER = ~ta.NOT_LETTER
_LOOKS = np.isin(np.arange(256), [ord(k) for k in LOOKS])
_FIRM = np.isin(np.arange(256), np.frombuffer(b"0123456789@$", np.uint8))
_JOINT = np.isin(np.arange(256), np.frombuffer(_JOINTS, np.uint8))
_HEAD = (np.arange(256) & 0xC0) != 0x80
_PLAIN = np.isin(np.arange(256), np.arange(97, 123))
_MARK = _LOOKS | _JOINT
_WIDTH = 1 + sum((np.arange(256) >= b).astype(np.int64) for b in (0xC0, 0xE0, 0xF0))
_SPACE, _EDGE = 0x20, 0x202020
_U = np.uint64


def _alternatives() -> tuple[np.ndarray, np.ndarray]:
    """(what a byte may be read as: a byte, 0 for nothing, -1 for no alternative; the costs)."""
    read, cost = np.full((256, 7), -1, np.int64), np.zeros((256, 7))
    for b in range(256):
        ends = [(0, COSTS["space"] if ta.SPACE[b] else COSTS["joint"]), (_SPACE, 0.0)]
        if _LETTER[b]:
            ends = [(b, 0.0)]
        elif _LOOKS[b]:
            ends = [*((ord(c), COSTS["swap"]) for c in LOOKS[chr(b)]), (0, COSTS["drop"]), (_SPACE, COSTS["break"])]
        read[b, : len(ends)], cost[b, : len(ends)] = zip(*ends, strict=True)
    return read, cost


_READ, _COST = _alternatives()


class Letters:
    """The source model: the logarithm of each gram's conditional probability as a written array, and that of unseen grams."""

    def __init__(self, path: str) -> None:
        self.path, self.floor = path, float(np.log(SMOOTH / 256 / (50 + SMOOTH)))

    def log_prob(self, gram: np.ndarray) -> np.ndarray:
        arrays = hasharrays.load(self.path)
        at, hit = arrays.find(gram)
        return np.where(hit, arrays.values[at], self.floor) if len(arrays.values) else np.full(len(gram), self.floor)


def train_letters(docs: DataFrame) -> Letters:
    """Counts of the words of all documents."""
    grams = materialize(count_grams(docs.select(F.lit("").alias("lang"), "text"), True, ta.NOT_LETTER, ORDER).select("gram", "n"), "letter-grams")
    rows = grams.withColumn("context", F.shiftright("gram", 8))
    sums = rows.groupBy("context").agg(F.sum("n").alias("total"))
    p = F.log((F.col("n") + SMOOTH / 256) / (F.col("total") + SMOOTH)).cast("float")
    path = hasharrays.write(rows.join(sums, "context").select("gram", p.alias("p")), "gram", "letter-arrays")
    discard(grams)
    return Letters(path)


def decode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: Letters) -> list[bytes]:
    """The likeliest reading of each stretch, words apart by single spaces."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    first, size = starts[order], size[order]
    n, longest = len(size), int(size.max(initial=0))
    seg, ctx, value = np.arange(n), np.full(n, _EDGE), np.zeros(n)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    best = np.zeros(n, np.int64)

    def settle(low: int, high: int) -> None:
        """The best last states of stretches [low, high), which end here."""
        mine = np.flatnonzero((seg >= low) & (seg < high))
        open_ = (ctx[mine] & 0xFF) != _SPACE
        total = value[mine].copy()
        total[open_] += letters.log_prob(ctx[mine][open_] << 8 | _SPACE)
        by = np.lexsort((-total, seg[mine]))
        lead = by[np.concatenate([[True], seg[mine][by][1:] != seg[mine][by][:-1]])] if len(by) else by
        best[seg[mine[lead]]] = mine[lead]

    alive = n
    for t in range(longest):
        now = int(np.searchsorted(-size, -t, "left"))  # stretches longer than t
        if now < alive:
            settle(now, alive)
            alive = now
        idx = np.flatnonzero(seg < alive)
        place = first[seg[idx]] + t
        b = data[place]
        again = _PLAIN[b] & (b == data[np.maximum(place - 1, 0)]) if t else np.zeros(len(b), bool)
        read = np.column_stack([_READ[b], np.where(again, 0, -1)])
        cost = np.column_stack([_COST[b], np.full(len(b), COSTS["repeat"])])
        row, col = np.nonzero(read >= 0)
        came, out = idx[row], read[row, col]
        v, c = value[came] - cost[row, col], ctx[came]
        said = (out > 0) & ~((out == _SPACE) & ((c & 0xFF) == _SPACE))
        v[said] += letters.log_prob(c[said] << 8 | out[said])
        c = np.where(out == 0, c, np.where(out == _SPACE, _EDGE, (c << 8 | out) & 0xFFFFFF))
        key = seg[came] << 24 | c
        by = np.lexsort((-v, key))
        by = by[np.concatenate([[True], key[by][1:] != key[by][:-1]])]
        seg, ctx, value = seg[came[by]], c[by], v[by]
        steps.append((came[by], out[by]))
    settle(0, alive)
    said = np.zeros((n, longest), np.uint8)
    for t in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        came, out = steps[t]
        said[:live, t] = out[best[:live]]
        best[:live] = came[best[:live]]
    made: list[bytes] = [b""] * n
    for i, k in enumerate(order):
        row = said[i, : size[i]]
        made[k] = b" ".join(row[row > 0].tobytes().split())
    return made


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The tokens that may be disguised, some of which are not: those with a look-alike, a joint or a byte three times in a row, and those of one letter. Most tokens are none of these."""
    same = data[1:] == data[:-1]
    keep = np.zeros(len(starts), bool)
    for at in (np.flatnonzero(_MARK[data]), np.flatnonzero(same[1:] & same[:-1])):
        keep[np.searchsorted(starts, at, "right") - 1] = True  # a space in a row marks the token before it, which does no harm
    follower = starts + _WIDTH[data[starts]]
    alone = follower >= ends
    alone[~alone] = ~(_LETTER | _LOOKS)[data[follower[~alone]]]
    return np.flatnonzero(keep | alone)


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the disguised stretches of lower-case texts, in order; none overlap."""
    starts, ends, doc = ta.spans(data, at)
    if not len(starts):
        return starts, ends
    kept = _kept(data, starts, ends)
    if not len(kept):
        return starts[:0], ends[:0]
    doc, gap = doc[kept], starts[kept][1:] - ends[kept][:-1]
    data, starts, ends, away = ta.gathered(data, starts[kept], ends[kept])
    upto = lambda m: np.concatenate([[0], np.cumsum(m)])
    letter, looks = _LETTER[data], _LOOKS[data]
    heads, signs, joints = upto(letter & _HEAD[data]), upto(looks), upto(_JOINT[data])
    triple = np.zeros(len(data), bool)
    triple[2:] = _PLAIN[data[2:]] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    triples = upto(triple)
    place = np.arange(len(data))
    last = np.maximum.accumulate(np.where(letter, place, -1))[ends - 1]  # the last letter of a token, if it has one
    first = np.minimum.accumulate(np.where(letter, place, len(data))[::-1])[::-1][starts]
    has = (last >= starts) & (heads[ends] - heads[starts] >= 2)
    last, first = np.maximum(last, starts), np.minimum(first, ends - 1)
    inner = lambda t, a: t[last] - t[np.minimum(a, last)]
    odd = has & ((inner(signs, starts) > 0) | (inner(joints, first) > 0) | (triples[ends] - triples[np.minimum(starts + 2, ends)] > 0))
    # tokens of one letter or look-alike, with other signs behind it in the last of a row only
    width = _WIDTH[data[starts]]
    own = upto((letter & _HEAD[data]) | looks)
    single = (letter | looks)[starts] & (own[ends] - own[starts] == 1)
    bare = single & (ends - starts == width)
    chained = np.zeros(len(starts), bool)  # goes on from the token before
    chained[1:] = bare[:-1] & single[1:] & (gap == 1) & (doc[1:] == doc[:-1])
    head = np.flatnonzero(~chained)
    count = np.diff(np.append(head, len(starts)))
    tail = head + count - 1
    stop = np.minimum(starts[tail] + width[tail], ends[tail])
    spaced = (count >= 3) & (heads[stop] - heads[starts[head]] >= 2)
    in_row = np.zeros(len(starts), bool)
    in_row[np.repeat(spaced, count)] = True
    odd &= ~in_row
    # signs around a stretch stay: it begins with its first letter or look-alike and ends with its last, of which marks of punctuation are none
    begin = np.minimum.accumulate(np.where(letter | looks, place, len(data))[::-1])[::-1][starts]
    end = np.maximum.accumulate(np.where(letter | _FIRM[data], place, -1))[ends - 1] + 1
    low = np.concatenate([(begin + away)[odd], (starts + away)[head[spaced]]])
    high = np.concatenate([(end + away)[odd], stop[spaced] + away[tail[spaced]]])
    order = np.argsort(low)
    return low[order], high[order]


def _pieces(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.maximum(1, -(-(high - low) // PIECE))
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(low, n) + part * PIECE
    return starts, np.minimum(starts + PIECE, np.repeat(high, n))


def restored(texts: pa.Array, letters: Letters) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of lower-case texts with their disguised stretches restored."""
    for base, data, at in ta.chunks(texts, lower=True):
        low, high = _pieces(*stretches(data, at))
        if not len(low):
            yield base, data, at
            continue
        _, lead, of = np.unique(ta.hashes(*ta.gathered(data, low, high)[:3]), return_index=True, return_inverse=True)
        made: list[bytes] = []
        for i in range(0, len(lead), AT_ONCE):
            made += decode(data, low[lead[i : i + AT_ONCE]], high[lead[i : i + AT_ONCE]], letters)
        out, done, raw = [], 0, data.tobytes()
        for a, b, k in zip(low.tolist(), high.tolist(), of.tolist(), strict=True):
            out += [raw[done:a], made[k]]
            done = b
        out.append(raw[done:])
        grown = np.array([len(m) for m in made])[of] - (high - low)
        doc = np.searchsorted(at, low, "right") - 1
        more = np.zeros(len(at), np.int64)
        np.add.at(more, doc + 1, grown)
        yield base, np.frombuffer(b"".join(out), np.uint8), at + np.cumsum(more)


def restore(docs: DataFrame, letters: Letters) -> DataFrame:
    """(doc_id, restored) for each row: the lower-case text with disguised stretches restored."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for _, data, at in restored(b.column("text"), letters) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, restored string")


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each different word of a text, index of the distinct word; word of each feature of distinct words, feature)."""
    starts, ends, doc = ta.spans(data, at, ta.NOT_LETTER)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = ta.hashes(data, starts, ends)
    # equal words come together, each in the order of its texts
    by = np.argsort(h, kind="stable")
    h, doc = h[by], doc[by]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    once = np.flatnonzero(new | np.concatenate([[True], doc[1:] != doc[:-1]]))
    of, lead = np.cumsum(new) - 1, by[new]
    word, feature = [np.arange(len(lead))], [h[new]]
    data, s, e, _ = ta.gathered(data, starts[lead], ends[lead])
    heads = np.flatnonzero(_HEAD[data])
    a, z = np.searchsorted(heads, s), np.searchsorted(heads, e)
    padded, hashed = np.append(heads, len(data)), ta.hasher(data)
    for k in BEGIN:
        some = np.flatnonzero(z - a >= k)
        stop = np.minimum(padded[np.minimum(a[some] + k, len(heads))], e[some])
        word.append(some)
        feature.append(ta.mix(hashed(s[some], stop) + _U(k)))
    return doc[once], of[once], np.concatenate(word), np.concatenate(feature).view(np.int64)


def feature_counts(labelled: DataFrame, letters: Letters) -> DataFrame:
    """(feature, toxic, clean): how many rows (text, y) of each label hold each feature. A task hands on sums, not rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held = [], [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.concatenate(keys), np.concatenate(sums)
            keys.clear(), sums.clear()
            by = np.argsort(k)
            k = k[by]
            lead = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[lead], np.add.reduceat(n[by], lead, axis=0)

        def rows(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[:, 1]), pa.array(n[:, 0])], ["feature", "toxic", "clean"])

        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            for base, data, at in restored(b.column("text"), letters):
                doc, word, of_word, feature = _words(data, at)
                if not len(doc):
                    continue
                # rows of each feature in each text that has its word, once
                by = np.argsort(of_word, kind="stable")
                n_of = np.bincount(of_word, minlength=int(of_word.max()) + 1)
                begin = np.cumsum(n_of) - n_of
                reps = n_of[word]
                pick = by[np.repeat(begin[word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
                f, d = feature[pick], np.repeat(doc, reps)
                order = np.lexsort((d, f))
                f, d = f[order], d[order]
                once = np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1])])
                f, label = f[once], y[base + d[once]]
                k, of_f = np.unique(f, return_inverse=True)
                keys.append(k)
                sums.append(np.column_stack([np.bincount(of_f, label == c, minlength=len(k)) for c in (0, 1)]).astype(np.int64))
                held += len(k)
                if held > 2 * FLUSH:
                    k, n = total()
                    held = len(k)
                    if held > FLUSH:
                        yield rows(k, n)
                        held = 0
                    else:
                        keys.append(k), sums.append(n)
        if held:
            yield rows(*total())
        pa.default_memory_pool().release_unused()

    found = labelled.select("text", "y").mapInArrow(of, "feature long, toxic long, clean long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


N = 5


@dataclass
class Model:
    """The source model, the written counts of the features that tell, how many rows of either label there were, and the regression."""

    letters: Letters
    path: str
    toxic: int
    clean: int
    weights: np.ndarray | None = None

    def evidence(self, texts: pa.Array, y: np.ndarray | None = None) -> np.ndarray:
        """A row of N figures for each text; with labels ``y`` each text is left out of the counts."""
        rows = []
        for base, data, at in restored(texts, self.letters):
            n = len(at) - 1
            doc, word, of_word, feature = _words(data, at)
            own = np.full(len(doc), -1) if y is None else y[base + doc]
            arrays = hasharrays.load(self.path)
            value = np.full(len(doc), -np.inf)
            if len(doc) and len(arrays.values):
                found, hit = arrays.find(feature)
                n_words = int(of_word.max()) + 1
                for label in np.unique(own):
                    a = np.maximum(arrays.values[found[hit], 0] - float(label == 1), 0)
                    b = np.maximum(arrays.values[found[hit], 1] - float(label == 0), 0)
                    ratio = np.log((a + 0.5) / (self.toxic - (label == 1) + 1)) - np.log((b + 0.5) / (self.clean - (label == 0) + 1))
                    ratio -= DOUBT * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
                    best = np.full(n_words, -np.inf)
                    np.maximum.at(best, of_word[hit], ratio)
                    value[own == label] = best[word[own == label]]
            tell = value > CUT
            count, words = np.bincount(doc[tell], minlength=n), np.bincount(doc, minlength=n)
            top = np.zeros(n)
            np.maximum.at(top, doc[tell], value[tell])
            total = np.bincount(doc[tell], value[tell], minlength=n)
            rows.append(np.column_stack([top, np.log1p(count), np.log1p(total), np.sqrt(count / np.maximum(words, 1)), np.log1p(words)]))
        return np.concatenate(rows) if rows else np.zeros((0, N))

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.toxic / max(1, self.toxic + self.clean))
        x = self.evidence(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:N] + self.weights[N], -700, 700)))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(text, y) of the documents that may be learnt from. Labels are sampled to about ``examples`` rows, and so may be broadcast: texts stay where they are."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("y"))
    known, seen = counted(known.where(F.col("k").isNotNull() & ~held_out(F.col("k"))), "toxic-labels")
    if seen["n"] > examples:
        known = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * examples / seen["n"]))
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), F.col("id") == F.col("k")).select("text", "y")


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, letters: Letters | None = None) -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    letters = letters or train_letters(docs)
    rows = labelled_rows(docs, labels, examples)
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    tell = feature_counts(rows, letters).where(F.col("toxic") >= LEAST).where((F.col("toxic") / max(toxic, 1)) > TIMES * (F.col("clean") / max(clean, 1)))
    path = hasharrays.write(tell.select("feature", F.array(F.col("toxic").cast("float"), F.col("clean").cast("float")).alias("n")), "feature", "toxic-features")
    model = Model(letters, path, toxic, clean)
    if not toxic or not clean:
        return model

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            x = model.evidence(b.column("text"), y)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N), pa.array(x.ravel())), pa.array(y.astype(float))], ["x", "label"])

    learnt = materialize(rows.mapInArrow(of, "x array<double>, label double"), "toxic-evidence")
    fit = LogisticRegression(regParam=1e-3, maxIter=100).fit(learnt.select(array_to_vector("x").alias("features"), "label"))
    model.weights = np.append(fit.coefficients.toArray(), fit.intercept)
    discard(learnt)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(b.column("text")))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
