"""The text operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import glob
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import (
    components, decontamination, hasharrays, html_extraction, language_id, near_dedup, personal_data, quality_classifier, quality_rules, secret_scan, source_mix, token_counts,
)
from barloom.llm.shared import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, node string"
WORDS = "the of and to river stone bright window seven garden letter quiet market winter paper silver morning thunder copper".split()


def docs(spark, texts, langs=None, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


AWKWARD = [None, "", " \n\t ", "one", "é", "same text twice", "same text twice", "word " * 5000, "👍" * 30, "a|b#c*\n\nx\nx\n"]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD, [None, "en", None, "en", "fr", "en", "en", "en", None, "de"], [None, "a", "a", None, "b", "b", "b", "c", "c", "c"], [None, 1, 2, 3, 4, 5, 5, 7, 8, 9])


def test_every_operator_takes_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, None), (None, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, None), (None, "same text twice"), (2, "")], "item_id long, text string")
    for rows, n in ((awkward, len(AWKWARD)), (awkward.limit(0), 0)):
        model, feats = quality_classifier.train(rows, labels)
        results = [
            quality_classifier.score(feats, model), near_dedup.classes(rows), decontamination.find(rows, items), secret_scan.scan(rows, secret_scan.infer(rows)),
            source_mix.mix(rows), token_counts.count_tokens(rows), language_id.predict(rows, language_id.train(rows)), quality_rules.judge(rows), personal_data.spans(rows),
        ]
        assert [r.count() for r in results] == [n] * len(results)


# near-duplicates
def runs(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicate_classes_are_those_of_brute_force(spark):
    rng, texts = random.Random(1), []
    for _ in range(25):
        base = prose(rng, 120).split()
        for k in range(4):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(1000)
            texts.append(" ".join(copy))
    hub = prose(rng, 100).split()
    for _ in range(60):  # one large bucket with links that no single leader sees
        copy = list(hub)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = "hub%d" % rng.randrange(1000)
        texts.append(" ".join(copy))
    texts += ["", None, "tiny text", "tiny text", texts[0]]
    bags, parent = [runs(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs(spark, texts), few=4).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    kept = near_dedup.keep_one(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i in range(len(texts))}) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_repeated_rows_leave_one(spark):
    same = docs(spark, ["a b c d e f", "a b c d e f", "g h i j k l"], ids=[3, 3, 4])
    assert sorted(r.doc_id for r in near_dedup.keep_one(same).collect()) == [3, 4]


def test_signatures_estimate_weighted_similarity():
    from barloom.llm import textarrays as ta

    rng = random.Random(2)
    a = [rng.choice(WORDS) for _ in range(300)]
    texts = pa.array([" ".join(a), " ".join(a[:200] + [rng.choice(WORDS) for _ in range(60)])])
    _, data, at = next(ta.chunks(texts))
    s = near_dedup.signatures(*near_dedup._bags(data, at, 1), 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(near_dedup.overlaps(texts[:1], texts[1:], 1)[0], abs=0.03)


def test_signatures_do_not_depend_on_the_size_class():
    from barloom.llm import textarrays as ta

    words = ["w%d" % i for i in range(1300)]
    texts = pa.array([" ".join(words[:n]) for n in (300, 560, 590, 1300)])
    _, data, at = next(ta.chunks(texts))
    s = near_dedup.signatures(*near_dedup._bags(data, at, 1), 4, 144)  # 560 and 590 runs lie on both sides of two expected points
    for a in s:
        for b in s:
            assert (np.isclose(a, b, rtol=1e-12, atol=0) == (a == b)).all()


def test_components(spark):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y")], "a string, b string")
    assert {r.node: r.component for r in components.components(links)[0].collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


# decontamination
def test_decontamination_recall_and_no_clean_hits(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 50))] for _ in range(30)]
    texts, truth = [], []
    for k in range(150):
        item = list(items[k % 30])
        for _ in range(rng.randrange(0, int(0.2 * len(item)) + 1)):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        dirty = k % 3 > 0
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(40)] + item * dirty + [rng.choice(vocabulary) for _ in range(40)]))
        truth.append(k % 30 if dirty else None)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.find(docs(spark, texts), table, block=7).collect()}
    dirty = [i for i, t in enumerate(truth) if t is not None]
    assert sum(truth[i] in got[i] for i in dirty) >= 0.9 * len(dirty)
    assert all(not got[i] for i, t in enumerate(truth) if t is None)
    assert decontamination.keep_clean(docs(spark, texts), table).count() == sum(not v for v in got.values())


def test_decontamination_recall_of_insertions_and_deletions(spark):
    rng = random.Random(21)
    vocabulary = ["w%d" % i for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 100))] for _ in range(40)]
    texts = []
    for k in range(240):
        item = list(items[k % 40])
        for _ in range(int(0.2 * len(item))):  # all the edits there may be
            at, what = rng.randrange(len(item)), k % 4
            what = rng.randrange(3) if what == 3 else what
            item[at : at + (what != 1)] = [] if what == 2 else [rng.choice(vocabulary)]
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(30)] + item + [rng.choice(vocabulary) for _ in range(30)]))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find(docs(spark, texts), table, block=11).collect()}
    assert sum(k % 40 in got[k].item_ids for k in range(240)) >= 0.95 * 240
    assert got == {r.doc_id: r for r in decontamination.find(docs(spark, texts), table).collect()}  # whatever the blocks


def test_edit_distance():
    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            row = _next(row, i, a, t)
        return min(row)

    def _next(row, i, a, t):
        out = [i]
        for j, b in enumerate(t, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (a != b)))
        return out

    rng = random.Random(4)
    for _ in range(200):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (9, 14))
        assert decontamination.distance(p, t) == slow(p, t)


# secrets
def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text or ""):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def test_secret_spans(spark):
    rng = random.Random(5)
    parts = ["token", "API_KEY", "passwd", " ", ":", "=", "'", '"', "abc", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef01234567", "é", "secret = x", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(600)]
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts += [f'words token = "{key()}" words' for _ in range(60)]
    loose = f"left {key().upper()[:20]}xyz right {key()[:12]}"
    texts += [loose, "4111111111111111 plainwordplainwordplainword"]
    rows = docs(spark, texts)
    got = {r.doc_id: r for r in secret_scan.scan(rows, secret_scan.infer(rows)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(brute_secrets(t).encode()).hexdigest()
        assert set(filter(None, brute_secrets(t).split(","))) <= set(got[i].spans.split(","))
    assert got[len(texts) - 1].spans == ""
    clean = secret_scan.redact(rows, secret_scan.infer(rows)).collect()
    assert all(not brute_secrets(r.text.replace("[SECRET]", "\0")) or "[SECRET]" in r.text for r in clean) and all(r.n_chars == len(r.text) for r in clean)


def ordinary_text():
    text = "The quiet river ran past seven stone gardens. HEADLINES on 2024-11-28 told of 1530 letters; a well-known window, and so on. " * 50
    k = np.concatenate([[0], secret_scan._NUMBER[np.frombuffer(text.encode(), np.uint8)], [0]])
    n = len(secret_scan.SYMBOLS)
    return secret_scan.Background(np.bincount(k[:-1] * n + k[1:], minlength=n * n).astype(float))


def test_automata_learn_lengths_prefixes_and_order():
    rng, shape, words = random.Random(6), secret_scan.shape, ordinary_text()
    digits, hexes = (lambda n, of=of: "".join(rng.choice(of) for _ in range(n)) for of in ("0123456789", "0123456789abcdef"))
    a = secret_scan.learn([shape(hexes(40)) for _ in range(131)])
    assert len({t for o in a.out for t in o.values()}) >= 40
    share = lambda x, make, n=200: sum(x.accepts(shape(make()), words) for _ in range(n)) / n
    assert share(a, lambda: hexes(40)) >= 0.9 and share(a, lambda: hexes(64)) == 0 and share(a, lambda: hexes(39)) == 0
    both = secret_scan.learn([shape("sk_" + digits(20) if i % 2 else hexes(40)) for i in range(300)])
    assert share(both, lambda: "sk_" + digits(20)) >= 0.9 and share(both, lambda: hexes(40)) >= 0.9 and share(both, lambda: "sk_" + hexes(20)) <= 0.05
    loose = secret_scan.learn([shape("".join(rng.choice("0123456789ghijklmnopGHIJKLMNOP") for _ in range(rng.randrange(10, 30)))) for _ in range(300)])
    assert share(loose, lambda: "".join(rng.choice("0123456789ghijklmnopGHIJKLMNOP") for _ in range(rng.randrange(12, 28)))) >= 0.9
    for a in (a, both, loose):
        assert not any(a.accepts(shape(w), words) for w in "The quiet river gardens 2024-11-28 HEADLINES well-known extraordinarily-longwords".split())


def test_scan_scores_are_those_of_each_candidate_alone():
    rng, words = random.Random(14), ordinary_text()
    a = secret_scan.learn([secret_scan.shape("".join(rng.choice("0123456789abcdef") for _ in range(8))) for _ in range(50)])
    for _ in range(200):
        form = secret_scan.shape("".join(rng.choice("01234abcde=/.") for _ in range(30)))
        for start, end, score, _ in a.scan(form, words):
            part = form[start:end]
            assert score == pytest.approx((a.likelihood(part) - words.between(form, words.sums(form), start, end)) / (len(part) + 1))


def test_short_and_glued_keys_are_scored():
    rng = random.Random(13)
    key = lambda: "".join(rng.choice("0123456789") + rng.choice("GHIJKLMNOP") for _ in range(6))
    formats = secret_scan.Formats({"assign": secret_scan.learn([secret_scan.shape(key()) for _ in range(200)])}, ordinary_text())
    for text, at in (("see %s here", 4), ("AUTH_KEY=%s", 9), ("/v1/hook/%s", 9), ("a.%s.b", 2)):
        assert (at, at + 12, "format") in secret_scan.all_spans(text % key(), formats)[1]
    assert secret_scan.all_spans("HYPHENATED 202411281530 on 2024-11-28 ordinary-looking words", formats)[1] == []


def test_credentials_without_key_words_are_found(spark):
    rng = random.Random(15)
    key = lambda n=40: "".join(rng.choice("0123456789GHIJKL") for _ in range(n))
    texts = [f'{prose(rng, 30)} token = "{key()}" {prose(rng, 10)}' for _ in range(130)]
    texts += [f"{prose(rng, 20)} {key()} {prose(rng, 10)}" for _ in range(60)] + [f"{prose(rng, 20)} {key(64)} {prose(rng, 10)}" for _ in range(60)]
    rows = docs(spark, texts)
    got = {r.doc_id: r for r in secret_scan.scan(rows, secret_scan.infer(rows)).collect()}
    assert sum("format:" in got[i].spans for i in range(130, 190)) >= 54 and not any("format:" in got[i].spans for i in range(190, 250))
    assert all(got[i].score is not None and got[i].score > 0 for i in range(130))
    clean = {r.doc_id: r.text for r in secret_scan.redact(rows, secret_scan.infer(rows)).collect()}
    assert all("[SECRET]" in clean[i] for i in range(130)) and all(clean[i] == texts[i] for i in range(190, 250))


# mixing
def test_mix_meets_targets_through_its_schedule(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(300)] + [None, ""]
    sources = [rng.choice(["a", "b", "c", "d", None]) for _ in range(290)] + ["tiny"] * 12
    rows = docs(spark, texts, sources=sources)
    taken = []
    for slots, within in ((source_mix.SLOTS, 6), (60, 4 * 1.5 * 9000 / 60)):
        by, got = {}, sorted(source_mix.mix(rows, slots).collect())
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            by.setdefault(sources[r.doc_id], [0, r.target, r.source_size])[0] += r.taken
        assert all(abs(t[0] - t[1]) <= within and t[1] <= 2 * t[2] for t in by.values())
        assert sum(t[1] for t in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
        assert got == sorted(source_mix.mix(rows, slots).collect())
        taken.append([r.taken for r in got])
    assert taken[0] != taken[1]


def test_mix_writes_as_few_files_as_its_rows_need(spark):
    rng = random.Random(8)
    rows = docs(spark, [prose(rng, rng.randrange(1, 60)) for _ in range(400)], sources=[rng.choice(["a", "b", "c", None]) for _ in range(400)])
    want, folder = sorted(source_mix.mix(rows).collect()), shared_dir(spark).removeprefix("file://")
    files = lambda: {f for f in glob.glob(f"{folder}/mix-*/part-*") if not f.endswith(".crc")}
    old, conf = files(), {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        mixed = source_mix.mix(rows.repartition(30))
        assert sorted(mixed.collect()) == want
        assert mixed.rdd.getNumPartitions() == 1 and len(files() - old) == 2  # one file of rows and one of targets, the others are gone
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# tokens
def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(public_tokenizers.path(token_counts.NAME)), random.Random(8)
    pool = "aAbé ÉßΣσİı'stdm<|>#1²½٣日本語の한국어 \t\n\x1c\x85\xa0 👍ﬁǅЖж…—’'ll'RE<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(800)] + ["<|endoftext|> x <|startoftext|>", "don't " * 3000]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 2048)


# languages
def test_languages_and_spans(spark):
    rng = random.Random(9)
    make = {"aa": "kalo mita renu sopa tiko", "bb": "zwerg knopf schrank pfiff", "ru": "река камень окно сад"}
    texts, langs = [], []
    for i in range(300):
        k = rng.choice(list(make))
        texts.append(" ".join(rng.choice(make[k].split()) for _ in range(30)))
        langs.append(k)
    texts += [" ".join(["kalo mita renu"] * 10 + ["knopf schrank zwerg"] * 6), "123 — 456", None]
    langs += [None, None, None]
    rows = docs(spark, texts, langs)
    got = {r.doc_id: r for r in language_id.predict(rows, language_id.train(rows)).collect()}
    assert sum(got[i].lang_pred == langs[i] for i in range(300)) >= 297
    assert [s.lang for s in got[300].spans] == ["aa", "bb"] and [s.words for s in got[300].spans] == [30, 18]
    assert [(got[i].lang_pred, got[i].score) for i in (301, 302)] == [("und", 0.0)] * 2


def test_best_paths_are_those_of_enumeration():
    import itertools

    rng = np.random.default_rng(18)
    for _ in range(60):
        sizes = rng.integers(0, 7, 5)
        scores, first = rng.normal(size=(sizes.sum(), 3)).astype(np.float32) * 4, np.cumsum(sizes) - sizes
        got = language_id.viterbi(scores, first, sizes, 2.5)
        for at, n in zip(first, sizes, strict=True):
            value = lambda path: sum(float(scores[at + k, y]) for k, y in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
            if n:
                assert value(got[at : at + n]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=int(n))), abs=1e-3)


def test_word_scores_and_letters_are_brute_force(spark):
    rng, make = random.Random(19), {"aa": "kalo mita renu sopa tiko", "bb": "zwerg knopf schrank pfiff", "ru": "река камень окно сад"}
    texts, langs = zip(*[(" ".join(rng.choice(v.split()) for _ in range(20)), k) for k, v in make.items() for _ in range(12)], strict=True)
    rows = docs(spark, list(texts) + ["река камень kalo mita — sopa"], [*langs, None])
    model, counts = language_id.train(rows), {}
    import zlib

    for i, (t, k) in enumerate(zip(texts, langs, strict=True)):
        if zlib.crc32(str(i).encode()) % 5:
            for w in t.split():
                line = b"   " + w.encode() + b" "
                for j in range(3, len(line)):
                    counts.setdefault(k, Counter())[line[j - 3 : j + 1]] += 1
    words = ["kalo", "knopf", "окно", "kamen"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = ends - [len(w.encode()) for w in words]
    got = model.scores(data, starts, ends)
    for i, w in enumerate(words):
        for j, k in enumerate(model.langs):
            line = b"   " + w.encode() + b" "
            want = 0.0
            for x in range(3, len(line)):
                total = sum(n for g, n in counts[k].items() if g[:3] == line[x - 3 : x])
                n = counts[k][line[x - 3 : x + 1]]
                want += np.log((n + 2 / 256) / (total + 2)) if n else float(model.floor[j])
            if (k == "ru") == (i == 2):
                assert got[i, j] == pytest.approx(want, rel=1e-4)
            else:
                assert got[i, j] < -5000
    r = language_id.predict(rows, model).collect()[-1]
    assert (r.lang_pred, [s.words for s in r.spans]) == ("aa", [2, 4]) and r.score == pytest.approx(12 / 22)


# quality
def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_quality_rules_base_and_bands(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(20, 200)).replace(" river", "\nriver") for _ in range(300)]
    texts += ["é x\n\né x\n \n \n" * 3, "a b c d e f g h " * 9, ""]
    junk = len(texts)
    texts += ["".join(rng.choice("xqzjkvw#&") for _ in range(900)).replace("z", " ") for _ in range(2)]
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(300)) and not got[junk].kept and not got[junk + 1].kept


def brute_kneser_ney(texts, order):
    """p(byte | context) by the textbook's recursion over dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        line = b"\n" * (order - 1) + b"".join(w.encode() + b" " for w in re.findall(r"[^\x20\x09-\x0D]+", t))
        for i in range(order - 1, len(line)):
            counts[order][line[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter()
        for g, k in counts[n + 1].items():
            counts[n][g[1:]] += k if g[1:2] == b"\n" else 1

    def discounts(n):
        n1, n2, n3, n4 = (max(1, sum(k == j for k in counts[n].values())) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return [min(0.9 * k, max(0.1 * k, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]

    d = {n: discounts(n) for n in counts}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 256
        after = [k for g, k in counts[n].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        k = counts[n][gram]
        return (max(0, k - d[n][min(k, 3) - 1]) if k else 0) / sum(after) + sum(d[n][min(x, 3) - 1] for x in after) / sum(after) * p(gram[1:])

    return p


def test_kneser_ney_is_brute_force_and_sums_to_one(spark):
    rng = random.Random(16)
    texts = [prose(rng, 12) for _ in range(15)] + ["stone stone", "", "é…"]
    model = quality_rules.train(docs(spark, texts, ["en", None, ""] * 6))
    of = {k: [t for i, t in enumerate(texts) if i % 3 == j] for j, k in enumerate(["=en", "null", "="])}
    order = quality_rules.ORDER
    for name, own in of.items():
        p, seed = brute_kneser_ney(own, order), np.full(256, quality_rules._seed(name), np.uint64)
        for context in (b"", b"stone", b"e sto", b"zzzzz", b"xyzst"):
            line = b"\n" * order + context
            grams = np.array([int.from_bytes(line[-order + 1 :] + bytes([k]), "big") for k in range(256)], np.uint64)
            got = np.exp(model.log_prob(seed, grams))
            assert got.sum() == pytest.approx(1, abs=1e-5)
            assert got == pytest.approx([p(line[-order + 1 :] + bytes([k])) for k in range(256)], rel=1e-4)
    rows = docs(spark, texts, ["en", None, ""] * 6)
    got = {r.doc_id: r.log_perplexity for r in quality_rules.measure(rows, model).collect()}
    for i, t in enumerate(texts):
        line = b"".join(w.encode() + b" " for w in re.findall(r"[^\x20\x09-\x0D]+", t))
        p, padded = brute_kneser_ney(of[["=en", "null", "="][i % 3]], order), b"\n" * (order - 1) + line
        want = [np.log(p(padded[k : k + order])) for k in range(len(line))]
        assert got[i] is None if not t else got[i] == pytest.approx(-sum(want) / len(want), rel=1e-4)


def test_shuffled_documents_fall_outside_the_bands(spark):
    rng, follows = random.Random(17), {}
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    for w in words:  # each word has three words that may follow
        follows[w] = rng.sample(words, 3)

    def text(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(follows[out[-1]]))
        return out

    texts = [text(rng.randrange(150, 300)) for _ in range(300)]
    bad = []
    for t in texts[:10]:
        t = list(t)
        rng.shuffle(t)
        bad.append(t)
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, [" ".join(t) for t in texts + bad])).collect()}
    assert sum(got[i].kept for i in range(300)) >= 297 and not any(got[i].kept for i in range(300, 310))
    assert all(got[i].log_perplexity > got[i].upper_band for i in range(300, 310))


def test_models_keep_rare_grams_of_large_inputs(spark):
    rows = docs(spark, ["stone river " * 5000] * 12 + ["xylograph"], ids=list(range(13)))
    rules, order = quality_rules.train(rows), quality_rules.ORDER
    gram = np.array([int.from_bytes(b"ograph"[-order:], "big")], np.uint64)
    arrays = hasharrays.load(rules.paths[order])
    assert arrays.find(quality_rules._key(np.array([quality_rules._seed("=en")], np.uint64), gram, order, False))[1].all()
    languages = language_id.train(docs(spark, ["stone river " * 5000] * 12 + ["xylograph"] * 4, ids=list(range(12)) + [100, 101, 102, 103]))
    assert int.from_bytes(b"raph", "big") in languages.arrays().keys


def test_quality_classifier_learns_held_out(spark):
    rng = random.Random(11)
    good = [prose(rng, rng.randrange(30, 200)) for _ in range(300)]
    bad = [" ".join(rng.choice(WORDS).upper() + "!!" for _ in range(100)) for _ in range(100)]
    rows = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, quality int")
    model, feats = quality_classifier.train(rows, labels)
    got = [r for r in quality_classifier.score(feats, model).collect() if r.held_out]
    assert got and sum(r.predicted == int(r.doc_id < 300) for r in got) >= 0.97 * len(got)
    assert quality_classifier.keep_good(rows, labels).columns == rows.columns


def test_discriminant_is_brute_force(spark):
    rng = np.random.default_rng(22)
    n, x = quality_classifier.N, {0: rng.normal(size=(9, quality_classifier.N)), 1: rng.normal(size=(40, quality_classifier.N)) + 1}  # fewer rows than statistics
    rows = spark.createDataFrame([(v.tolist(), y) for y, m in x.items() for v in m], "f array<double>, y int")
    model = quality_classifier.fit(rows)
    pooled = sum(len(m) * np.cov(m.T, bias=True) for m in x.values()) / 49

    def density(z, y):
        s = 0.8 * np.cov(x[y].T, bias=True) + 0.2 * pooled
        s = 0.98 * s + 0.02 * (np.trace(s) / n + 1e-9) * np.eye(n)
        d = z - x[y].mean(axis=0)
        return np.log(len(x[y]) / 49) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * d @ np.linalg.inv(s) @ d

    tests = rng.normal(size=(30, n)) * 2
    assert model.score(tests) == pytest.approx([1 / (1 + np.exp(density(z, 0) - density(z, 1))) for z in tests], abs=1e-8)


def test_statistics_are_those_of_plain_python():
    rng = random.Random(23)
    texts = [prose(rng, 80).replace(" river", "\nRiver") + " | é #1!! " + "same line\nsame line", "", "one", "A b\n" * 30]
    got = quality_classifier.statistics(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x]
        share, grams = lambda a, b: a / max(b, 1), [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        letters = re.findall("[A-Za-z]", t)
        want = [
            np.log1p(len(words)), np.log1p(share(sum(len(w.encode()) for w in words), len(words))), np.log1p(share(len(words), len(lines))),
            np.log(share(sum(c in "#*$%&<>~^=@_\\{}[]" for c in t), len(t)) + 0.01), np.log(share(t.count("|"), len(words)) + 0.01), np.log(share(sum(c in "!?" for c in t), len(words)) + 0.01),
            np.log(share(sum(c.isupper() for c in letters), len(letters)) + 0.01), np.log(share(sum(c in "0123456789" for c in t), len(t)) + 0.01), np.log(share(sum(c in ".,;:" for c in t), len(words)) + 0.01),
            share(len(set(words)), len(words)) * np.log1p(len(words)) ** 0.5, np.log(share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)) + 0.01),
            np.log(share(len(grams) - len(set(grams)), len(words)) + 0.01), np.log(share(len(lines) - len(set(lines)), len(lines)) + 0.01), np.log(share(sum(ord(c) > 127 for c in t), len(t)) + 0.01),
        ]
        assert row == pytest.approx(want)


def test_ties_at_half_are_predicted_one(spark):
    model = quality_classifier.fit(spark.createDataFrame([([0.0] * quality_classifier.N, y) for y in (0, 1)] * 3, "f array<double>, y int"))
    feats = quality_classifier.features(docs(spark, ["a b", "a b", None]))
    assert [(r.score, r.predicted) for r in quality_classifier.score(feats, model).collect()] == [(0.5, 1)] * 3


# personal data
def luhn(d):
    return sum(x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(re.sub("[ -]", "", v)) <= 19 and luhn(re.sub("[ -]", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def test_personal_spans_and_disclosing_terms(spark):
    rng = random.Random(12)
    pool = ["@", ".", "a", "b1", "%", "+", "1", "23", "255", "256", " ", "-", "(", "é", "👍", "4111111111111111", "+1 (555) 123-4567", "x@y.zz", "1.2.3.4", "\n"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(500)] + [" ".join(str(rng.randrange(10**6)) for _ in range(5000))]
    got = {r.doc_id: r for r in personal_data.spans(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PERSONAL) for m in re.finditer(p, t) if ok(m[0]))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{e}" for a, _, e, n in want).encode()).hexdigest()
    told = [f"note {w} about Zorblax who lives here zorb@x.org and {w} more" for w in "alpha beta gamma delta".split()] + [f"note about more text {i} here lives" for i in range(60)] + ["call zorblax", None]
    rows = docs(spark, told)
    spans = {r.doc_id: r.spans for r in personal_data.spans(rows).collect()}
    assert spans[64] == "term:5:12" and spans[30] == "" and "email:" in spans[0] and "term:" in spans[0]
    clean = {r.doc_id: r.text for r in personal_data.sanitise(rows).collect()}
    assert clean[64] == "call " and "[EMAIL]" in clean[0] and clean[30] == told[30] and clean[65] is None


def test_copied_and_rare_entities_disclose(spark):
    filler = [f"plain text about the weather number {i}" for i in range(400)]
    copied = [f"record {i} of Quandrel with quan@x.org in it" for i in range(3)] * 100
    rare = ["ask Vimbrasto at vimb@y.org about the weather", "letter to vimbrasto", "pay 4111 1111 1111 1111 by Ostrevane", "pay 4111-1111-1111-1111 by ostrevane"]
    texts = filler + copied + rare
    spans = {r.doc_id: r.spans for r in personal_data.spans(docs(spark, texts)).collect()}
    assert all("term:12:20" in spans[400 + i].split(",") for i in range(300))
    assert all("term:%d:%d" % at in spans[i].split(",") for i, at in ((700, (4, 13)), (701, (10, 19)), (702, (27, 36)), (703, (27, 36))))
    assert all(spans[i] == "" for i in range(400))


def test_disclosing_terms_are_those_of_brute_force(spark):
    rng = random.Random(20)
    names = ["zorblax", "quandrel", "vimbrasto", "ostrevane", "thelonwick"]
    texts = []
    for i in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        if i % 7 == 0:
            k = rng.randrange(5)
            words.insert(rng.randrange(len(words)), rng.choice([names[k], names[k].title(), rng.choice(names)]) + rng.choice(["", " the "]) + f" mail{k}@x.org")
        if i % 31 == 0:
            words.append(rng.choice(names) + " " + rng.choice(["+1 (555) 123-4567", "+1 555 1234567", "10.0.0.1"]))
        texts.append(" ".join(words))
    texts += texts[:40] * 3 + ["", None, names[0], names[1] + " again"]
    unique, N = sorted({t or "" for t in texts}), len({t or "" for t in texts})
    near, holds, entities = {}, Counter(), Counter()
    for t in unique:
        holds.update(set(re.findall(r"[^\W\d_]{3,}", t.lower())))
        found = {}
        for k, (name, p, ok) in enumerate(PERSONAL):
            for m in re.finditer(p, t):
                if ok(m[0]):
                    value = m[0].lower() if name == "email" else ".".join(str(int(x)) for x in m[0].split(".")) if name == "ip" else re.sub("[^0-9]", "", m[0])
                    for w in re.finditer(r"[^\W\d_]{3,}", t.lower()):
                        if m.start() - personal_data.WINDOW <= w.start() and w.end() <= m.end() + personal_data.WINDOW and not (m.start() <= w.start() < m.end()):
                            found.setdefault((k, value), set()).add(w[0])
                    found.setdefault((k, value), set())
        for e, own in found.items():
            entities[e] += 1
            for w in own:
                near[e, w] = near.get((e, w), 0) + 1
    want = {w for (e, w), n in near.items() if np.log2((holds[w] + 1) / (n + entities[e] / N)) <= personal_data.LEFT}
    rows = docs(spark, texts)
    kept, n, _ = personal_data.texts_of(rows)
    some = personal_data.base(kept.selectExpr("0L doc_id", "t text", "digest"), "digest").where("size(found) > 0")
    got = {r.term for r in personal_data.disclosing(some, kept, n).collect()}
    assert n == N and got == want and {"zorblax"} <= want and not want & {"the", "of"}
    for r in personal_data.spans(rows).collect():
        t = texts[r.doc_id] or ""
        own = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in want}
        assert {x for x in r.spans.split(",") if x.startswith("term")} == own


# pages
def test_main_text():
    model = html_extraction.train()
    page = (
        '<!DOCTYPE html><html><head><title>No</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- no --><div class="ad">Buy this now, please.</div>'
        "<article><h1>A title &amp; more</h1><p><b>First line of the\n  article, which goes on for quite a while.<br><p>Second paragraph of the article, &eacute; with more words in it.</p></article>"
        "<footer>&copy; someone</footer></body></html>"
    )
    assert html_extraction.extract(page, model) == "A title & more\nFirst line of the article, which goes on for quite a while.\nSecond paragraph of the article, é with more words in it."
    assert [html_extraction.extract(x, model) for x in (None, "", "<p", "<div></div>", "<!-- open")][:2] == ["", ""]


FIRST, SECOND = "The first paragraph of the article, which goes on for quite a while.", "Its second paragraph has words, too, and it ends here."


@pytest.mark.parametrize(
    "page",
    [
        "<body><article><h1>Title</h1><svg-icon></svg-icon><p>{a}</p><select-box><p>{b}</p></select-box></article></body>",
        "<body><article><h1>Title</h1><svg viewBox='0 0 1 1'/><p>{a}</p><p>{b}</p></article></body>",
        "<body><article><h1>Title</h1><svg><path d='M1'/><text>no</text></svg><p>{a}</p><p>{b}</p></article></body>",
        "<head><title>no</title><meta charset=utf-8><article><h1>Title</h1><p>{a}</p><p>{b}</p></article>",
        "<html><head><title>no</title></head><article><h1>Title</h1><p title=it's>{a}</p><p title='a > b'>{b}</p></article>",
        "<body><article><h1>Title</h1><p>{a}</p><select><option>no<option>no</select><noscript><p>no</p></noscript><p>{b}</p></article></body>",
        "<body><article><h1>Title</h1><p>{a}</p><video><p>no</video><p>{b}</p></article><div hidden><p>Not to be seen by any reader.</p></div></body>",
        '<BODY><ARTICLE><H1>Title</H1><SCRIPT>if (a < b) document.write("<p>no</p>")</SCRIPT ><P>{a}</P><TEXTAREA><p>no</p></TEXTAREA><P>{b}</P></ARTICLE></BODY>',
    ],
)
def test_common_forms_of_html(page):
    assert html_extraction.extract(page.format(a=FIRST, b=SECOND), html_extraction.train()) == f"Title\n{FIRST}\n{SECOND}"


def test_pages_without_tags_and_awkward_rows(spark):
    model = html_extraction.train()
    assert html_extraction.extract(f"{FIRST} &amp;\n{SECOND}", model) == f"{FIRST} & {SECOND}"
    page = f"<body><article><p>{FIRST}</p><p>{SECOND}</p></article><footer>no</footer></body>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", page, "x"), (3, "u", page, "x"), (3, "u", page, "x"), (4, "u", "<p>" + "long words " * 50_000, "x"), (5, "u", "<" * 1000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extraction.main_text(pages, html_extraction.train(pages)).collect()
    assert [r.n_chars == len(r.text) for r in got] == [True] * 7 and [r.text for r in got[:2]] == ["", ""]
    assert [r.text for r in got[2:5]] == [f"{FIRST}\n{SECOND}"] * 3 and got[5].n_chars == 11 * 50_000 - 1
    assert html_extraction.main_text(pages.limit(0), html_extraction.train(pages.limit(0))).count() == 0


def test_marginals_are_those_of_enumeration():
    import itertools

    model = html_extraction.train()
    nodes, _ = html_extraction.parse("<body><div class=menu><p>Two words</p></div><div><p>Many words, which tell a story in a sentence. They go on for a while, as prose does, and end here.</p></div></body>")
    emissions = [list(model.emission(n)) for n in nodes]
    emissions[0] = [e * r for e, r in zip(emissions[0], model.roots, strict=True)]
    total, sums = 0.0, [[0.0] * 3 for _ in nodes]
    for states in itertools.product(range(3), repeat=len(nodes)):
        p = 1.0
        for i, s in enumerate(states):
            p *= emissions[i][s] * (model.potential[states[nodes[i].parent]][s] if i else 1)
        total += p
        for i, s in enumerate(states):
            sums[i][s] += p
    for got, want in zip(model.marginals(nodes), sums, strict=True):
        assert got == pytest.approx([x / total for x in want], abs=1e-9)


def test_pipeline_runs_over_the_smallest_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= 200 and set(out.columns) >= {"doc_id", "size", "taken", "target"}


def test_hash_arrays_find_what_they_hold(spark):
    rng = np.random.default_rng(24)
    for keys in (rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(0, 50_000, 3000), np.zeros(0, np.int64), np.array([2**63 - 1, -(2**63)])):
        keys = np.unique(keys)
        arrays = hasharrays.HashArray(rng.permutation(keys), np.zeros(len(keys)))
        arrays = hasharrays.HashArray(keys, np.arange(len(keys)).astype(float))
        ask = np.concatenate([keys, keys + 1, rng.integers(-(2**63), 2**63 - 1, 500)]) if len(keys) != 2 else keys
        at, hit = arrays.find(ask)
        assert (hit == np.isin(ask, keys)).all() and (not len(keys) or (keys[at[hit]] == ask[hit]).all())
    path = hasharrays.write(spark.createDataFrame([], "key long, value float"), "key", "nothing")
    assert not hasharrays.load(path).find(np.arange(3))[1].any()
