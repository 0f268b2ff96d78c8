"""Near-duplicate classes of documents: BagMinHash signatures, bands, and exact verification of multiset overlap.

A text is the multiset of its runs of five words (``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one run). Two texts are linked
if the weighted Jaccard similarity of these multisets, sum of minima over sum of maxima, is 0.8 or more; a class is a connected component
of links, and equal texts are always in one class. Runs are told apart by 44 bits of their hashes, here and in the verification.

Signature. Weights are whole numbers, cut into the levels [0,1), [1,2), [2,4), [4,8) and so on. For each element and each such range a
Poisson process runs over time; its points carry a component and a level within the range, and count if the level is below the element's
weight, so that a range the weight covers only in part is thinned. A component's value is the time of its earliest point. Two texts agree
in a component with a probability equal to their weighted Jaccard similarity. Points beyond the time by which all components are expected
to be filled are never made; a text with an empty component is done again with twice that time.

Search. Equal texts are first folded to one node (the MD5 of the text). In each bucket of equal bands, and of two and three neighbouring bands, every
member is compared with the bucket's least node, so a bucket of k members makes k-1 pairs; then, where a bucket holds several components, with one node
that a hash of its own picks for each bucket. Where a bucket still holds several components, all its pairs across components are
compared if it has ``SMALL`` members at most. The members of larger ones are matched by prefixes: ordered from rare to common, texts of
similarity 0.8 share a run among the first fifth of each (rarity by a sketch of ``SLOTS`` counters), so only pairs that do are compared, and no link
between components that share a bucket is lost. With 24 bands of 6 a pair of similarity 0.8 shares a bucket with probability 0.9993. The components are contracted
before what was found last is added to them.

Hot groups. Copies of one text meet in aggregations with partial results only; nodes with more than one in ``HOT`` of all rows, of which there are
fewer than ``HOT``, are joined to their rows by a broadcast of that proven size. Tables are broadcast behind a count of their rows, else joined by shuffles.

Cases: a text that is null or has no word is a class of its own row, whatever else is empty. A null doc_id is kept as null; it never gives
a class its name unless the class has no other. Repeated rows are equal texts. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import components, merged
from .shared import counted, discard, lean, materialize, small, table

WORDS, SIMILARITY, BANDS, ROWS, SMALL, HOT, SLOTS, POINTS = 5, 0.8, 24, 6, 32, 1000, 1 << 20, 1 << 18
_U = np.uint64
_COMPONENT, _LEVEL = _U(0x632BE59BD9B4E019), _U(0xA0761D6478BD642F)


def _bags(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, element, weight), ascending by text and element; elements are 44 bits of the shingle's hash."""
    starts, ends, doc = ta.spans(data, at)
    d, h = ta.shingles(ta.hashes(data, starts, ends), doc, words)
    out = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    # 2**20 texts fit beside the 44 bits
    key = np.sort((d.astype(_U) << _U(44)) | (h >> _U(20)))
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out[0].append((key[first] >> _U(44)).astype(np.int64))
        out[1].append(key[first] & _U((1 << 44) - 1))
        out[2].append(np.diff(np.append(first, len(key))))
    return tuple(np.concatenate(x) for x in out)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((ta.mix(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """n x size earliest times; a row of infinities for a text without elements."""
    out = np.full((n, size), np.inf)
    total = np.bincount(doc, weight, minlength=n)
    limit = (np.log(size) + 3) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        rows = np.flatnonzero(todo[doc])
        _fill(out, doc[rows], element[rows], weight[rows], limit, size)
        todo &= np.isinf(out).any(axis=1)
        limit = np.where(todo, 2 * limit, limit)
        out[todo] = np.inf
    return out


def _fill(out: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, size: int) -> None:
    level = 0
    while len(doc):
        low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
        seed = ta.mix(element * ta._STEP + _U(level + 1))
        _process(out, doc, seed, weight, low, high, limit, size)
        level += 1
        more = weight > high
        doc, element, weight = doc[more], element[more], weight[more]


def _process(out: np.ndarray, doc: np.ndarray, seed: np.ndarray, weight: np.ndarray, low: int, high: int, limit: np.ndarray, size: int) -> None:
    """Points of rate (high - low) for each component, up to each text's limit, as many at a time as are expected, POINTS in all."""
    flat, rate = out.ravel(), float(size * (high - low))
    expected = rate * limit[doc]
    size_class = np.floor(np.log2(np.maximum(expected, 1))).astype(np.int64)
    for k in np.unique(size_class):
        many = 1 if k == 0 else int(1.3 * 2 ** (k + 1))
        own = np.flatnonzero(size_class == k)
        at_once = max(1, POINTS // many)
        for first in range(0, len(own), at_once):
            rows, now, step = own[first : first + at_once], np.zeros(min(at_once, len(own) - first)), 0
            while len(rows):
                x = seed[rows, None] + ta._G * (np.arange(step, step + many, dtype=np.uint64) + _U(1))[None, :]
                gaps = -np.log(_uniform(x))
                gaps[:, 0] += now
                gone = np.cumsum(gaps, axis=1)  # added one by one, so that a point's time has the same bits whatever ``many`` is
                t = gone / rate
                r, c = np.nonzero(t < limit[doc[rows]][:, None])
                point, when, row = x[r, c], t[r, c], rows[r]
                if high - low > 1:
                    keep = low + _uniform(point ^ _LEVEL) * (high - low) < weight[row]
                    point, when, row = point[keep], when[keep], row[keep]
                component = ((ta.mix(point ^ _COMPONENT) >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
                np.minimum.at(flat, doc[row] * size + component, when)
                go = t[:, -1] < limit[doc[rows]]
                rows, now, step = rows[go], gone[go, -1], step + many


def _band_hashes(times: np.ndarray, rows: int) -> np.ndarray:
    bits = times.view(_U).reshape(len(times), -1, rows)
    h = np.zeros(bits.shape[:2], _U) + np.arange(1, bits.shape[1] + 1, dtype=_U)[None, :]
    for k in range(rows):
        h = ta.mix(h * ta._STEP + bits[:, :, k])
    return h.view(np.int64)


def _node(text: str = "text") -> F.Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def sign(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, keys) for each row: the text's digest and the hashes of its bands, null for a text without words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, parts, some = b.column("text"), [], []
            for _, data, at in ta.chunks(texts, most=ta.CHUNK_BYTES // 2):
                bag = _bags(data, at, words)
                times = signatures(*bag, len(at) - 1, bands * rows)
                some.append(~np.isinf(times[:, 0]))
                parts.append(_band_hashes(times, rows))
            if not parts:
                continue
            keys, has = np.concatenate(parts), np.concatenate(some)
            ends = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.if_else(pa.array(has), b.column("node"), pa.scalar(None, pa.binary())), lists], ["doc_id", "node", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text", _node().alias("node")).mapInArrow(lean(of), "doc_id long, node binary, keys array<long>")


def overlaps(one: pa.Array, other: pa.Array, words: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 if either has no word."""
    out, most, i = [], ta.CHUNK_BYTES, 0
    size = np.cumsum(pc.add(pc.fill_null(pc.binary_length(one), 0), pc.fill_null(pc.binary_length(other), 0)).to_numpy(zero_copy_only=False))
    while i < len(one):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        d, e, w, side = [], [], [], []
        for k, texts in enumerate((one[i:j], other[i:j])):
            for base, data, at in ta.chunks(texts, most=1 << 62):
                x = _bags(data, at, words)
                d.append(x[0] + base), e.append(x[1]), w.append(x[2]), side.append(np.full(len(x[0]), k))
        d, e, w, side = (np.concatenate(x) for x in (d, e, w, side))
        order = np.lexsort((side, e, d))
        d, e, w = d[order], e[order], w[order]
        total = np.bincount(d, w, minlength=j - i)
        both = np.flatnonzero((d[1:] == d[:-1]) & (e[1:] == e[:-1]))
        shared = np.bincount(d[both], np.minimum(w[both], w[both + 1]), minlength=j - i)
        out.append(shared / np.maximum(total - shared, 1))
        i = j
    return np.concatenate(out) if out else np.zeros(0)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = pa.array(overlaps(b.column("ta"), b.column("tb"), words) >= similarity)
            yield b.select(["a", "b"]).filter(good)

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(lean(of), "a binary, b binary")


def _tokens(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, index of the text, token, size of each text); a run that occurs w times makes w tokens, so sets stand for multisets."""
    for base, data, at in ta.chunks(texts):
        doc, element, weight = _bags(data, at, words)
        again = np.repeat(np.arange(len(doc)), weight)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(weight) - weight, weight)
        yield base, doc[again], ta.mix(element[again] * ta._STEP + nth.astype(_U)), np.bincount(doc, weight, minlength=len(at) - 1).astype(np.int64)


def _sketch(texts: DataFrame, words: int) -> np.ndarray:
    """How often tokens occur, by SLOTS slots of their hashes: never less than the truth. A fixed size, so it may reach the driver and every task."""
    part = 1 << 14

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, _, token, _ in _tokens(b.column("text"), words):
                total += np.bincount((token % _U(SLOTS)).astype(np.int64), minlength=SLOTS)
        for k in range(0, SLOTS, part):
            if total[k : k + part].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k : k + part]])], ["slot", "counts"])

    def add(pdf):
        return pdf.iloc[:1].assign(counts=[np.sum(np.stack(pdf["counts"].to_list()), axis=0)])

    schema = "slot long, counts array<long>"
    out = np.zeros(SLOTS, np.int64)
    for r in texts.mapInArrow(lean(of), schema).groupBy("slot").applyInPandas(add, schema).collect():
        out[r.slot : r.slot + part] = r.counts
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _prefixes(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, component, token, size, rank) of the rarest tokens of each text of ``rows`` (node, component, text), so many that texts similar enough share one.

    Any one order of all tokens will do; theirs is by the sketch. A token that the sketch counts once has no partner and is left out.
    """
    often = _sketch(rows, words)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, doc, token, size in _tokens(b.column("text"), words):
                count = often[(token % _U(SLOTS)).astype(np.int64)]
                order = np.lexsort((token, count, doc))
                doc, token, count = doc[order], token[order], count[order]
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
                keep = (rank <= size[doc] - np.ceil(size[doc] * similarity - 1e-9) + 1) & (count > 1)
                at = pa.array(base + doc[keep])
                yield pa.RecordBatch.from_arrays([b.column("node").take(at), b.column("component").take(at), pa.array(token[keep].view(np.int64)), pa.array(size[doc[keep]]), pa.array(rank[keep])], ["node", "component", "token", "size", "rank"])

    return rows.mapInArrow(lean(of), "node binary, component binary, token long, size long, rank long")


def _leaders(buckets: DataFrame, bands: int) -> DataFrame:
    """Pairs (a, b) of each member of a bucket and its least node; also of buckets of two and three neighbouring bands, whose members are more alike."""
    own = buckets.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("own"))  # a node has as many as there are bands at most
    band = lambda i, k: F.element_at("own", ((i + k) % bands).cast("int"))

    def joined(m: int) -> F.Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.when(sum((band(i, k).isNull().cast("int") for k in range(m)), F.lit(0)) == 0, F.xxhash64(i, *(band(i, k) for k in range(m)))))

    wide = own.select("node", F.explode(F.array_compact(F.concat(joined(2), joined(3)))).alias("bucket"))
    wide = wide.join(wide.groupBy("bucket").agg(F.min("node").alias("lead")), "bucket")
    return buckets.select("node", "lead").unionByName(wide.select("node", "lead")).where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))


def _across(buckets: DataFrame, of: DataFrame, n_of: int) -> DataFrame:
    """The members, with their components, of buckets that hold several components."""
    members = buckets.join(small(of, n_of), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    return materialize(members.join(split.select("bucket"), "bucket"), "dedup-apart")


def _others(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member and one node of another component in its bucket, the first by a hash that differs from bucket to bucket."""
    lead = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "component")).alias("by"))
    pairs = members.join(lead, "bucket").where("component != by.component")
    return pairs.select(F.least("node", "by.node").alias("a"), F.greatest("node", "by.node").alias("b")).distinct()


def _rest(members: DataFrame, texts: DataFrame, words: int, similarity: float, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs (a, b) of different components that share a bucket and may be similar enough; and the written tables they read.

    Pairs with a bucket's least node are done before. Small buckets give their other pairs as they are; the members of larger ones are matched by
    the rarest runs, which misses no similar pair.
    """
    tight = members.where((F.col("n") <= few) & (F.col("node") != F.col("lead")))
    x, y = (tight.select("bucket", F.col("node").alias(k), F.col("component").alias("c" + k)) for k in "ab")
    pairs = x.join(y, "bucket").where("ca != cb and a < b").select("a", "b")
    apart = members.where(F.col("n") > few).select("node", "component").distinct()
    large, seen = counted(texts.join(apart, "node").select("node", "component", "text"), "dedup-large")
    if not seen["n"]:
        return pairs.distinct(), [large]
    prefix = materialize(_prefixes(large, words, similarity), "dedup-prefixes")
    # the component most rows of a token belong to needs no pairs of its own
    main = prefix.groupBy("token", "component").count().groupBy("token").agg(F.max(F.struct("count", "component")).alias("main"), F.count("*").alias("kinds"))
    marked = prefix.join(main.where("kinds > 1").select("token", F.col("main.component").alias("main")), "token")
    x = marked.where("component != main").select("token", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("size").alias("sx"), F.col("rank").alias("rx"))
    y = marked.select("token", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("size").alias("sy"), F.col("rank").alias("ry"))
    # what both have from here on must suffice for the overlap that their sizes ask for
    enough = 1 + F.least(F.col("sx") - F.col("rx"), F.col("sy") - F.col("ry")) >= F.ceil((F.col("sx") + F.col("sy")) * (similarity / (1 + similarity)) - 1e-9)
    more = x.join(y, "token").where("cx != cy").where(enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.unionByName(more).distinct(), [large, prefix]


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, few: int = SMALL) -> DataFrame:
    """(doc_id, class_id, node, is_kept) for each row; class_id is the least doc_id of the class, is_kept marks that document's rows."""
    signed, seen = counted(sign(docs, words, bands, rows), "dedup-signatures", F.count("node").alias("with_words"))
    per_node = signed.where(F.col("node").isNotNull()).groupBy("node")
    members = per_node.agg(F.first("keys").alias("keys")).select("node", F.posexplode("keys").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    buckets = materialize(members.join(shared, "bucket"), "dedup-buckets")
    candidates = buckets.select("node").distinct()
    texts = docs.select(_node().alias("node"), "text").where(F.col("text").isNotNull()).join(candidates, "node", "left_semi")
    texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "dedup-texts")

    pairs = _leaders(buckets, bands).distinct()
    links = materialize(verified(pairs, texts, words, similarity), "dedup-links")
    of, n_of = components(links)
    members = _across(buckets, of, n_of)
    found = materialize(verified(_others(members), texts, words, similarity), "dedup-links")
    of, n_of = merged(of, n_of, found)
    discard(links, found, members)
    members = _across(buckets, of, n_of)
    pairs, read = _rest(members, texts, words, similarity, few)
    found = materialize(verified(pairs, texts, words, similarity), "dedup-links")
    of, n_of = merged(of, n_of, found)
    discard(texts, buckets, found, members, *read)

    per_node = per_node.agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = per_node.join(small(of, n_of), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select("node", "least", "copies", "component"), "dedup-named")
    names = named.groupBy("component").agg(F.min("least").alias("class_id"))
    named = named.join(names, "component").select("node", "class_id", "copies")
    hot = F.col("copies") * HOT > seen["with_words"]
    rows_of = signed.select("doc_id", "node")
    hot_nodes = F.broadcast(named.where(hot).drop("copies"))
    out = rows_of.join(hot_nodes, "node").unionByName(rows_of.join(hot_nodes, "node", "left_anti").join(named.where(~hot).drop("copies"), "node", "left"))
    own = F.col("node").isNull()
    return out.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "node",
        (own | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, with one row of each class."""
    marked = materialize(classes(docs), "dedup-classes")
    gone = marked.where("not is_kept").select("doc_id", "node").distinct()
    again = marked.where("is_kept and node is not null").groupBy("doc_id", "node").count().where("count > 1").select("doc_id", "node")
    key = next(f"_node{k}" for k in ("", *range(len(docs.columns) + 1)) if f"_node{k}" not in docs.columns)
    keyed = docs.withColumn(key, _node())
    same = lambda t: keyed["doc_id"].eqNullSafe(t["doc_id"]) & (keyed[key] == t["node"])
    kept = keyed.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return kept.drop(key)
    single = kept.join(again, kept["doc_id"].eqNullSafe(again["doc_id"]) & (kept[key] == again["node"]), "left_anti")
    double = kept.join(again, kept["doc_id"].eqNullSafe(again["doc_id"]) & (kept[key] == again["node"]), "left_semi").dropDuplicates(["doc_id", key])
    return single.unionByName(double).drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")
