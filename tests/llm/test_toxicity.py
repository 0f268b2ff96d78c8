"""Toxicity: readings against enumeration, counts against plain loops, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import toxicity

DOCS = "doc_id long, text string, lang string, score string, y int, k string"
CLEAN = "the river stone bright window seven garden letter quiet market winter paper silver morning thunder copper".split()
BAD = "idiot moron stupid worthless clown".split()
SIGNS = {"i": "1!", "o": "0", "e": "3", "a": "4@", "s": "5$", "t": "7+", "l": "1|"}


def hidden(word, rng):
    """A disguise of a word."""
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(rng.choice(SIGNS[c]) if c in SIGNS and rng.random() < 0.7 else c for c in word)
    if kind == 1:
        return rng.choice([" ", ".", "-"]).join(word)
    if kind == 2:
        at = rng.randrange(len(word))
        return word[:at] + word[at] * 4 + word[at + 1 :]
    return "".join(c * rng.choice([1, 1, 3]) for c in word)


@pytest.fixture(scope="module")
def tables(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(900):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 60))]
        toxic, held = rng.random() < 0.3, zlib.crc32(str(i).encode()) % 3 == 1
        if toxic:
            for _ in range(3):
                bad = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), hidden(bad, rng) if held else bad)
        rows.append((i, " ".join(words).capitalize() + ".", "en", "x", 9, "z"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(tables[0], tables[1])


def test_disguised_words_of_held_out_documents_are_caught(tables, model):
    docs, _, truth, _ = tables
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert not [r for r in held if r.predicted and not truth[r.doc_id]]


def test_restored_text(spark, model):
    texts = {
        "You 1d10t, a CL0WN": "you idiot, a clown", "s t u p i d river": "stupid river", "m.o.r.o.n stone": "moron stone", "wooooorthless w-i-n-d-o-w": "worthless window",
        "stup!d quiet 12 345": "stupid quiet 12 345", "The market. Winter, paper!": "the market. winter, paper!", "": "", "!!! ### 000": "!!! ### 000", "a b": "a b",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = [r.restored for r in toxicity.restore(df, model.letters).orderBy("doc_id").collect()]
    assert got == [*texts.values(), ""]


class Plain:
    """A source with chances for every gram."""

    def log_prob(self, gram):
        return -1 - (np.asarray(gram).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(float) / 3


def test_readings_are_those_of_enumeration():
    rng, source = random.Random(7), Plain()
    made = ["".join(rng.choice("aab1$*.- é") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["aaa", "1", "é.é"]
    made = [w for w in made if w.strip()]
    data, starts, ends = np.frombuffer("\n".join(made).encode(), np.uint8), [], []
    at = 0
    for w in made:
        starts.append(at)
        at += len(w.encode())
        ends.append(at)
        at += 1
    got = toxicity.decode(data, np.array(starts), np.array(ends), source)
    for w, reading in zip(made, got, strict=True):
        raw, best = w.encode(), None
        options = []
        for i, b in enumerate(raw):
            own = [(int(r), float(c)) for r, c in zip(toxicity._READ[b], toxicity._COST[b], strict=True) if r >= 0]
            if i and raw[i - 1] == b and 97 <= b <= 122:
                own.append((0, toxicity.COSTS["repeat"]))
            options.append(own)
        for path in itertools.product(*options):
            ctx, value = 0x202020, 0.0
            for out, cost in path:
                value -= cost
                if out == 32:
                    value += float(source.log_prob(ctx << 8 | 32)) if ctx & 0xFF != 32 else 0.0
                    ctx = 0x202020
                elif out:
                    value += float(source.log_prob(ctx << 8 | out))
                    ctx = (ctx << 8 | out) & 0xFFFFFF
            value += float(source.log_prob(ctx << 8 | 32)) if ctx & 0xFF != 32 else 0.0
            text = b" ".join(bytes(o for o, _ in path if o).split())
            best = max(best or (value, text), (value, text))
            if text == reading:
                mine = value if text != best[1] else best[0]
        assert reading == best[1] or mine == pytest.approx(best[0])


def test_feature_counts_are_those_of_plain_loops(spark, tables, model):
    docs, labels, truth, texts = tables
    rows = toxicity.labelled_rows(docs, labels)
    got = sorted((r.toxic, r.clean) for r in toxicity.feature_counts(rows, model.letters).collect())
    by = {}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 3 != 1:
            words = {"".join(c for c in w if c.isalpha()).lower() for w in t.split()}
            for f in {("word", w) for w in words} | {(k, w[:k]) for w in words for k in toxicity.BEGIN if len(w) >= k}:
                by.setdefault(f, [0, 0])[1 - truth[i]] += 1
    assert got == sorted(map(tuple, by.values()))


def test_long_stretches_are_read_whole(model):
    long = "1d10t." * 2000
    [(_, data, at)] = toxicity.restored(pa.array([long, "x", None]), model.letters)
    text = data.tobytes().decode()
    assert list(at[1:] - at[:-1])[1:] == [1, 0] and text.count("idiot") > 1900


def test_awkward_rows(spark, model):
    rows = [(None, None), (1, ""), (1, ""), (2, "a" * 300_000), (3, "é" * 9), (4, "👍👍👍 1 2 3 4"), (5, "you idiot " * 30_000), (5, "you idiot " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], DOCS)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id == 5] == [1, 1] and {r.predicted for r in got if r.doc_id != 5} == {0}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = spark.createDataFrame([(7, 2), (None, 1), (8, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.train(df, none)).collect()} == {0.0}
    one = spark.createDataFrame([(2, 1), (5, 1)], "doc_id long, toxic int")
    ids = [i for i in (2, 5) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert {r.score for r in toxicity.score(df, toxicity.train(df, one)).collect()} == ({1.0} if ids else {0.0})
    empty = df.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


def test_held_out_accuracy_of_the_query(spark):
    path = "/root/testdata/sf0.01"
    out = toxicity.query(spark, path)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    known = out.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    right = sum(r.predicted == r.toxic for r in known) / len(known)
    assert len(known) > 100 and right > 0.95
    assert out.count() == spark.read.parquet(f"{path}/documents.parquet").count()


def test_each_byte_is_hashed_about_once(tables, model, monkeypatch):
    texts = pa.array([t for t in tables[3].values()][:300])
    hashed, powers = [], toxicity.ta._powers
    monkeypatch.setattr(toxicity.ta, "_powers", lambda n: hashed.append(n) or powers(n))
    model.evidence(texts)
    assert 0 < sum(hashed) < 2 * sum(len(t.as_py().encode()) for t in texts)


def test_stretches_do_not_depend_on_the_texts_beside_them():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "a1$ .", "aab!  \n", "éa0 *", "  .,-_", "aaa bbb "][rng.randrange(6)]) for _ in range(rng.randint(0, 40))) for _ in range(400)]

    def found(texts):
        return [[(a - at[np.searchsorted(at, a, "right") - 1], data[a:b].tobytes()) for a, b in zip(*toxicity.stretches(data, at), strict=True)] for _, data, at in toxicity.ta.chunks(pa.array(texts))]

    alone = [x for t in texts for x in found([t])]
    assert found(texts) == [[x for f in alone for x in f]]
    assert sum(map(len, alone)) > 100
