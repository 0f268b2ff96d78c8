"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from barloom.llm import spelling_variants


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n, out = plain_words(rows), {}
    for w in n:
        near = [v for v in n if one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v)) if near else None
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form, w, n[w], len(near), n[form] if form else None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 7))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "Straße", "ÀÉstraße", "lettérs"]
    rows = []
    for i in range(400):
        picked = [base[min(len(base) - 1, int(rng.expovariate(0.08)))] for _ in range(30)]
        for k, w in enumerate(picked):
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                picked[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abc") + w[at:], w[:at] + "b" + w[at + 1 :]])
        rows.append((i, rng.choice([" ", "-", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in picked)))
    rows += [(None, "alpha alpha alpha alphb"), (5, None), (6, ""), (7, "beta " * 20_000), (7, "beta " * 3), (8, "letter letter letter letter letter letter lettér lettér lettér")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, word string, root string, n int")
    want = plain(rows)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] != w and v[0] != v[1] for w, v in want.items())
    assert got(spelling_variants.variants(df)) == want
    assert got(spelling_variants.variants(df.limit(0))) == {}


def test_query_over_the_smallest_tables_is_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    out = spelling_variants.query(spark, path)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(out) == plain(rows)


@pytest.mark.parametrize("word", ["aab", "abca", "éé", "x"])
def test_rotations_meet_all_edits_once(spark, word):
    letters = "abcxé"
    edits = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + word[i + 1 :] for i in range(len(word))}
    edits = sorted((edits | {word}) - {""})
    df = spark.createDataFrame([(w, len(edits) - k) for k, w in enumerate(edits)], "word string, n long")
    near = {r.word: (r.n_near, r.form) for r in spelling_variants.neighbours(df).collect()}
    n = {w: len(edits) - k for k, w in enumerate(edits)}
    want = {w: (len(v), min(v, key=lambda x: (-n[x], x))) for w in edits if (v := [x for x in edits if one_apart(w, x)])}
    assert near == want
