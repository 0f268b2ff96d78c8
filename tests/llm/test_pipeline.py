"""The corpus pipeline, row by row, against stages in plain Python; and each filtering operator on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import decontamination, near_dedup, quality_classifier, quality_rules, secret_scan, source_mix

from .test_text import AWKWARD, brute_secrets, docs, prose, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_quality(rows, labels):
    x = {r[0]: quality_classifier.statistics(pa.array([r[1]], pa.string()))[0] for r in rows}
    known = [(x[d], y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    by = {y: np.array([v for v, k in known if k == y]) for y in (0, 1)}
    pooled = sum(len(m) * np.cov(m.T, bias=True) for m in by.values()) / len(known)
    n = quality_classifier.N

    def density(z, y):
        s = 0.8 * np.cov(by[y].T, bias=True) + 0.2 * pooled
        s = 0.98 * s + 0.02 * (np.trace(s) / n + 1e-9) * np.eye(n)
        d = z - by[y].mean(axis=0)
        return math.log(len(by[y]) / len(known)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.inv(s) @ d

    return [r for r in rows if density(x[r[0]], 1) >= density(x[r[0]], 0)]


def plain_dedup(rows):
    bags, parent = [runs(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                a, b = root(i), root(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return [r for i, r in enumerate(rows) if root(i) == i]


def plain_clean(rows, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            out = [i]
            for j, b in enumerate(t, 1):
                out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (a != b)))
            row = out
        return min(row)

    return [r for r in rows if not any(least(words(t), words(r[1])) <= int(0.2 * len(words(t)) + 1e-9) for _, t in items)]


def plain_redact(rows):
    out = []
    for r in rows:
        text, at, made = r[1], 0, ""
        for start, end in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in filter(None, brute_secrets(text).split(","))):
            if end > at:
                made += text[at:start] + "[SECRET]" if start >= at else ""
                at = end
        made += text[at:]
        out.append((r[0], made, r[2], r[3], len(made)))
    return out


def plain_mix(rows):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in names}
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        free, left = free - over, left - sum(2 * total[s] for s in over)
    block = max(1, min(4096, int(sum(target.values()) // 65536)))
    edges = np.cumsum([0.0] + [target[s] for s in names]) / sum(target.values())
    u = ((np.arange(math.ceil(sum(target.values()) / block)) + 0.5) * source_mix.PHI) % 1.0
    slots = dict(zip(names, np.bincount(np.searchsorted(edges, u, "right") - 1, minlength=len(names)), strict=True))
    out = {}
    for s in names:
        at, most = 0, slots[s] * block
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            n = size[r[0]]
            out[r[0]] = (n, total[s], target[s], sum(max(0, min(at + k * total[s] + n, most) - (at + k * total[s])) for k in (0, 1)))
            at += n
    return out


def test_pipeline_is_that_of_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng, texts = random.Random(31), []
    vocabulary = ["w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(600)]
    fresh = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(15))) for i in range(6)]
    for _ in range(90):
        texts.append(fresh(rng.randrange(60, 150)))
    for i in range(25):  # copies, near copies and others below the similarity
        words = texts[i].split()
        for _ in range((0, 1, 2, 30)[i % 4]):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    for i in range(12):
        part = items[i % 6][1].split()
        part[rng.randrange(15)] = "changed"
        texts.append(f"{fresh(40)} {' '.join(part)} {fresh(30)}")
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts += [f'{fresh(50)} token = "{key()}" {fresh(20)}' for _ in range(10)] + [f"{fresh(50)} {key()} {fresh(20)}" for _ in range(5)]
    good = len(texts)
    texts += [" ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(100)) for _ in range(40)]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < good)) for i in range(len(texts)) if i % 10 != 3]
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    folder, stages = f"file://{tmp_path}", dict(corpus_pipeline.STAGES)
    now, frame = rows, spark.read.parquet(f"{folder}/documents.parquet")
    plain = {
        "quality_classifier": lambda r: plain_quality(r, labels), "near_dedup": plain_dedup, "decontamination": lambda r: plain_clean(r, items), "secret_scan": plain_redact,
    }
    for name, step in plain.items():
        before, now = now, step(now)
        frame.write.parquet(f"{folder}/in-{name}")
        frame = stages[name](spark, spark.read.parquet(f"{folder}/in-{name}"), folder)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, frame.collect())) == sorted(now), name
        assert len(now) < len(before) or name == "secret_scan" and now != before
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in corpus_pipeline.run(spark, folder).collect()}
    want = plain_mix(now)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {k for k in want if k >= good} == set()


def test_filters_on_awkward_rows(spark):
    awkward = docs(spark, AWKWARD, ids=[None, 1, 2, 3, 4, 5, 5, 7, 8, 9])
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, None), (None, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, None), (None, "same text twice"), (2, "")], "item_id long, text string")
    texts = lambda df: sorted((str(r.text), str(r.doc_id)) for r in df.collect())
    every = texts(awkward)
    deduped = near_dedup.keep_one(awkward)
    assert texts(deduped) == sorted(set(every)) and deduped.columns == awkward.columns  # the repeated row goes, rows without words stay
    assert texts(decontamination.keep_clean(awkward, items)) == [x for x in every if x[0] != "same text twice"]
    redacted = secret_scan.redact(awkward, secret_scan.infer(awkward))
    assert texts(redacted) == every and redacted.columns == awkward.columns
    kept = quality_classifier.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and set(texts(kept)) <= set(every)
    mixed = source_mix.mix(awkward).collect()
    assert sorted(r.size for r in mixed) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in AWKWARD) and all(0 <= r.taken <= 2 * r.size for r in mixed)
    both = quality_rules.judge(docs(spark, [prose(random.Random(1), 40)] * 4, [None, "", None, ""])).collect()
    assert len(both) == 4 and all(r.kept for r in both)
    empty = awkward.limit(0)
    assert [f.count() for f in (near_dedup.keep_one(empty), decontamination.keep_clean(empty, items), secret_scan.redact(empty, secret_scan.infer(empty)), quality_classifier.keep_good(empty, labels), source_mix.mix(empty))] == [0] * 5
