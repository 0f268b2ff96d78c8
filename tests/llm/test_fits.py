"""Bounds of work: automata of long examples, reads of index blocks."""

import random
import time

import pyarrow as pa

from barloom.llm import decontamination, secret_scan


def plain_merge(a, same_depth):
    """The merging order by looking at all states each time."""
    red = [0]
    while True:
        known = set(red)
        blue = min(((a.depth[t], -a.visits[t], t) for p in red for x in a.out[p].values() for t in [a._now(x)] if t not in known), default=None)
        if blue is None:
            return
        t = blue[2]
        for r in red:
            if (a.depth[r] == a.depth[t] or not same_depth) and a._compatible(r, t, set()):
                a._unite(r, t)
                red = list(dict.fromkeys(map(a._now, red)))
                break
        else:
            red.append(t)


def states(a):
    live, seen, out = [0], {0}, []
    while live:
        q = live.pop(0)
        out.append((a.visits[q], a.ends[q], sorted(a.out[q]), a.end[q]))
        for _, t in sorted(a.out[q].items()):
            if t not in seen:
                seen.add(t)
                live.append(t)
    return out


def test_heap_merges_as_looking_at_all_states_does(monkeypatch):
    rng = random.Random(2)
    forms = [lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([6, 9]))), lambda: "".join(rng.choice("aZ9-_=") for _ in range(rng.randint(1, 20))), lambda: "tok-" + "".join(rng.choice("017") for _ in range(4)) + "=" * rng.randint(0, 2)]
    for k in range(24):
        strings = sorted(secret_scan.shape(forms[k % 3]()) for _ in range(rng.randint(1, 40)))
        for alpha in (None, 0.05, 0.001):
            got = states(secret_scan.Automaton(strings, alpha))
            with monkeypatch.context() as m:
                m.setattr(secret_scan.Automaton, "_merge", plain_merge)
                assert states(secret_scan.Automaton(strings, alpha)) == got


def test_long_examples_fit_in_bounded_time():
    rng = random.Random(1)
    strings = [secret_scan.shape("".join(rng.choice("abcxyzABCXYZ012789") for _ in range(256))) for _ in range(1000)]
    start = time.time()
    a = secret_scan.learn(strings)
    assert time.time() - start < 60 and a.least == 256


def test_blocks_are_read_once_for_all_held_texts(spark, monkeypatch):
    rng = random.Random(3)
    words = "river stone bright window seven garden letter quiet market winter paper silver morning thunder copper".split()
    items = [(i, " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(14))) for i in range(30)]
    blocks = decontamination.indexes(spark.createDataFrame(items, "item_id long, text string"), block=8)
    reads = []
    inner = decontamination.Blocks.__iter__
    monkeypatch.setattr(decontamination.Blocks, "__iter__", lambda self: (reads.append(1), inner(self))[1])
    texts = ["clean text of nothing much to see " * 3 + (items[i % 30][1] if i % 3 == 0 else "") + " and more of it" for i in range(90)]
    batches = lambda: (pa.RecordBatch.from_pydict({"doc_id": list(range(i, i + 9)), "text": texts[i : i + 9]}) for i in range(0, 90, 9))
    for held, times in ((1 << 30, 1), (1, 10)):
        reads.clear()
        found = {}
        for b, hits in blocks.search(batches(), held):
            for names, of in hits:
                for row, items_of in of.items():
                    found[b.column("doc_id")[row].as_py()] = [names[x] for x in items_of]
        assert found == {i: [i % 30] for i in range(0, 90, 3)} and len(reads) == times
    assert list(blocks.search(iter([]))) == []


DEEP = [f"<body>{('<div' + c + '>') * d}<p>{{a}}</p><p>{{b}}</p>{'</div>' * d}</body>" for d in (1, 2, 3, 5, 10, 50) for c in ("", " class=x")]
TITLED = [
    f"<body>{head}<{part}>{first}<p{lead}>{{a}}</p>{mid}</{part}></body>"
    for part in ("article", "main")
    for head, first, lead, mid in (
        ("", "<h1>Title</h1>", "", "<ul class='links'><li>{b}</li></ul>"), ("", "<h1>Title</h1>", " class=comment-lead", "<p>{b}</p>"),
        ("", "<h1>Title</h1>", " class=promo-lead", "<p>{b}</p>"), ("<header><h1>Site</h1></header>", "<h1>Title</h1>", "", "<p>{b}</p>"),
        ("", "<header><h1>Title</h1></header>", "", "<p>{b}</p>"), ("", "<h1>Title</h1>", "", "<button>Share</button><p>{b}</p>"),
        ("", "<h1>Title</h1>", "", "<ul class=links><li><a href=x>More</a></li><li><a href=y>Other</a></li></ul><p>{b}</p>"),
    )
]


def test_forms_of_pages_under_both_models(spark):
    from barloom.llm import html_extraction

    a, b = "The first paragraph of the article, which goes on for quite a while.", "Its second paragraph has words, too, and it ends here."
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for model in (html_extraction.train(), html_extraction.train(pages)):
        assert {html_extraction.extract(p.format(a=a, b=b), model) for p in DEEP} == {f"{a}\n{b}"}
        assert {html_extraction.extract(p.format(a=a, b=b), model) for p in TITLED} == {f"Title\n{a}\n{b}"}


def test_self_labelled_pages_are_counted_in_their_tasks(spark):
    from barloom.llm import html_extraction as h

    rows = [(r.html,) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()] * 2
    got = h.train(spark.createDataFrame(rows, "html string"))
    plain, hand = h.Model(), [h.parse(p)[0] for p in h.layouts()]
    for nodes in hand:
        plain.learn(nodes, h.labels_of(nodes, own=False))
    for k in ("{x}", "{s}", "{short}"):
        plain.learn(h.parse(h._PIECES[k])[0], [h.CONTENT])
    own = [(n, y) for p in {p for (p,) in rows if p and ("<article" in p or "<main" in p)} for n in [h.parse(p)[0]] for y in [h.labels_of(n, own=True)] if y]
    weight = min(1.0, sum(map(len, hand)) / sum(len(n) for n, _ in own))
    for nodes, y in own:
        one = h.Model()
        one.learn(nodes, y)
        for (t, k), n in one.seen.items():
            plain.seen[t, k] += weight * n
    assert own and got.seen.keys() == plain.seen.keys() and all(abs(got.seen[k] - plain.seen[k]) < 1e-6 for k in got.seen)
