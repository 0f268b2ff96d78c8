"""Hard negatives: rows of another label that score just below an anchor's positives, by threshold joins over blocks.

Scores are integer inner products of floored components. Anchors (ids divisible by ``EVERY``) are the stated query set; rows are dealt by their id into slices of about ``SLICE``,
anchors into groups of about ``GROUP``, and each pair of a slice and a group is one task's block. A block is a threshold join:

* The dimensions are put in order of their energy in the block. A row's inverted index holds its leading dimensions only, up to the place from which the norm of
  its remaining components times the largest norm of the group's anchors stays below ``SHARE`` of the largest score that the block could hold: what is omitted cannot reach
  that alone, and for lower thresholds the bound below counts it.
* Indexed dimensions give partial scores. A pair goes on only if its partial score plus the product of the remaining norms reaches the anchor's
  threshold; then the omitted dimensions are added, exactly and in integers.
* Thresholds start high and are lowered until each window is full or its lower end is reached: an anchor's first positives, then the first negatives of each positive.

Every block hands on no more than its own first rows of each window, so merging the blocks' windows gives the whole result: nothing is dropped. Bounds are
floating-point with slack; what they let through is verified in integers.

Cases. Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor does the empty vector's row fail: it scores 0 with all. Vectors of different lengths
are filled up with zeros. If an id occurs twice its least (label, vector) stands for it. A row is no positive of itself. Ties go to the smaller id.
Empty tables, and anchors without positives, give no rows. Other columns are ignored. Scores beyond 2**63 are not foreseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import counted, discard, materialize, table

EVERY, SEVENTH, LABELS, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
SLICE, GROUP, AT_ONCE = 16_384, 4_096, 64
#: A threshold's share of the one before.
LOWER = 0.7
SHARE = 0.3
#: Relative slack of floating-point bounds.
SLACK = 1e-9


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, with their slips of label and their floored components."""
    v_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(v_id.alias("vec_id"), F.when(v_id % SEVENTH == 0, (label + 1) % LABELS).otherwise(label).alias("label"), x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(fine)
    return rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE)).cast("array<long>").alias("v"))


def _blocks(rows: DataFrame, n_rows: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(group, slice, ...) rows and anchors: a row stands once in its slice for each group, an anchor once in its group for each slice."""
    slices, groups = max(1, -(-n_rows // SLICE)), max(1, -(-n_rows // (EVERY * GROUP)))
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("v")))
    rows = rows.select("vec_id", "label", filled.alias("v"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    there = rows.select("*", mine(slices, 1).alias("slice"), each(groups).alias("group"))
    # columns of their own, as both sides meet again
    asking = rows.where(F.col("vec_id") % EVERY == 0).select(*[F.col(c).alias(c) for c in rows.columns])
    anchors = asking.select("*", mine(groups, 2).alias("group"), each(slices).alias("slice"))
    return there, anchors


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) in order of ids; of rows with one id the least."""
    ids, labels = (t.column(k).to_numpy() for k in ("vec_id", "label"))
    v = t.column("v").combine_chunks().flatten().to_numpy() if len(ids) else np.zeros(0, np.int64)
    v = v.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort([*v.T[::-1], labels, ids])
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
    else:
        order = np.argsort(ids)
    return ids[order], labels[order], v[order]


class Block:
    """The inverted index of a slice's rows for a group of anchors: partial scores over the indexed dimensions, and what the others may still add."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, share: float) -> None:
        x, y = rows.astype(float), anchors.astype(float)
        order = np.argsort(-(np.square(x).sum(axis=0) + np.square(y).sum(axis=0)), kind="stable")
        self.rows, self.anchors = rows[:, order], anchors[:, order]
        x, y = x[:, order], y[:, order]
        # norms of what follows each dimension, for every row and anchor
        after = np.sqrt(np.cumsum(np.square(x[:, ::-1]), axis=1)[:, ::-1])
        reach = np.sqrt(np.square(y).sum(axis=1)).max(initial=0) * after
        depth = (reach > share * reach.max(initial=0)).sum(axis=1)
        self.depth = int(depth.max(initial=0))
        self.indexed = x.copy()
        self.indexed[np.arange(x.shape[1])[None, :] >= depth[:, None]] = 0
        self.indexed, self.y = self.indexed[:, : self.depth], y
        none = lambda m: np.concatenate([m, np.zeros((len(m), 1))], axis=1)
        self.rest, self.left = none(after)[np.arange(len(x)), depth], depth
        self.tail = none(np.sqrt(np.cumsum(np.square(y[:, ::-1]), axis=1)[:, ::-1]))

    def bounds(self, chunk: slice) -> np.ndarray:
        """The most that each (anchor, row) can score."""
        part = self.y[chunk, : self.depth] @ self.indexed.T
        size = self.tail[chunk, :1] * np.sqrt(np.square(self.indexed).sum(axis=1))[None, :]
        return part + self.tail[chunk][:, self.left] * self.rest[None, :] + SLACK * (1 + size)

    def score(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        return self.rows[rows] @ self.anchors[anchor]


def _levels(first: float, lowest: int) -> Iterator[int]:
    """Ever lower thresholds, down to the lowest."""
    now, step = first, abs(first) * (1 - LOWER) + 1
    while now > lowest:
        yield int(now)
        now, step = now - step, 2 * step
    yield lowest


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by score, then id."""
    if len(score) > 4 * n:
        edge = -np.partition(-score, n - 1)[n - 1]
        some = np.flatnonzero(score >= edge)
        return some[np.lexsort((ids[some], -score[some]))][:n]
    return np.lexsort((ids, -score))[:n]


def _positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """Each anchor's first rows of its label in this slice."""
    ids, labels, v = _read(rows)
    a_ids, a_labels, a = _read(anchors)
    out = []
    # the rows of one label are what can be positive, so each label has its own index
    for label in np.unique(a_labels) if len(ids) else ():
        mine, asks = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
        if not len(mine):
            continue
        block = Block(v[mine], a[asks], SHARE)
        for at in range(0, len(asks), AT_ONCE):
            bounds = block.bounds(slice(at, at + AT_ONCE))
            bounds[a_ids[asks[at : at + AT_ONCE], None] == ids[mine][None, :]] = -np.inf  # not itself
            for i, bound in enumerate(bounds):
                have, known, score = np.zeros(0, int), np.zeros(len(mine), bool), np.zeros(0, np.int64)
                can = bound[bound > -np.inf]
                if not len(can):
                    continue
                for level in _levels(can.max() * LOWER, int(np.floor(can.min())) - 1):
                    new = np.flatnonzero((bound >= level) & ~known)
                    known[new] = True
                    have, score = np.concatenate([have, new]), np.concatenate([score, block.score(at + i, new)])
                    if (score >= level).sum() >= POSITIVES:
                        break
                for k in _first(score, ids[mine][have], POSITIVES):
                    out.append((a_ids[asks[at + i]], ids[mine[have[k]]], score[k]))
    return _table(out, ("anchor_id", "positive_id", "score"))


def _negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """For each anchor and each of its windows [low, high]: this slice's first rows of other labels."""
    ids, labels, v = _read(rows)
    windows: dict[int, list[tuple[int, int]]] = {}
    for k, lows, highs in zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "lows", "highs")), strict=True):
        windows[k] = list(zip(lows, highs, strict=True))
    a_ids, a_labels, a = _read(anchors.select(["vec_id", "label", "v"]))
    out = []
    if not len(ids) or not len(a_ids):
        return _table(out, ("anchor_id", "low", "high", "negative_id", "score"))
    block = Block(v, a, SHARE)
    for at in range(0, len(a_ids), AT_ONCE):
        for i, bound in enumerate(block.bounds(slice(at, at + AT_ONCE))):
            spans = windows[int(a_ids[at + i])]
            floor, top = min(low for low, _ in spans), max(high for _, high in spans)
            bound[labels == a_labels[at + i]] = -np.inf
            have, known, score = np.zeros(0, int), np.zeros(len(ids), bool), np.zeros(0, np.int64)
            for level in _levels(top * (1 + LOWER) / 2, floor):
                new = np.flatnonzero((bound >= level) & ~known & (bound > -np.inf))
                known[new] = True
                have, score = np.concatenate([have, new]), np.concatenate([score, block.score(at + i, new)])
                if all(level <= low or ((score >= level) & (score <= high)).sum() >= NEGATIVES for low, high in spans):
                    break
            for low, high in spans:
                inside = np.flatnonzero((score >= low) & (score <= high))
                for k in inside[_first(score[inside], ids[have[inside]], NEGATIVES)]:
                    out.append((a_ids[at + i], low, high, ids[have[k]], score[k]))
    return _table(out, ("anchor_id", "low", "high", "negative_id", "score"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(np.array(c, np.int64)) for c in columns], names=list(names))


def _ranked(rows: DataFrame, window: list[str], other: str, n: int) -> DataFrame:
    """The first n of each window over all blocks, with their rank."""
    w = Window.partitionBy(*window).orderBy(F.col("score").desc(), other)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mine(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows, seen = counted(prepared(vectors), "negatives-rows", F.max(F.size("v")).alias("most"))
    there, anchors = _blocks(rows, seen["n"], seen["most"] or 0)
    key = ["group", "slice"]
    pairs = there.groupBy(*key).cogroup(anchors.groupBy(*key)).applyInArrow(_positives, "anchor_id long, positive_id long, score long")
    positives = materialize(_ranked(pairs, ["anchor_id"], "positive_id", POSITIVES).drop("rank"), "negatives-positives")
    # a score s is inside if LOW * positive <= 100 * s <= HIGH * positive; positives of one score share a window, and a negative score has none
    low, high = F.expr(f"({LOW} * score + 99) div 100"), F.expr(f"({HIGH} * score) div 100")
    spans = positives.where("score >= 0").select("anchor_id", "positive_id", F.col("score").alias("positive_score"), low.alias("low"), high.alias("high"))
    # an anchor has POSITIVES windows at most
    asks = spans.groupBy("anchor_id").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("w"))
    asks = anchors.join(asks, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", *key, F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = there.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(_negatives, "anchor_id long, low long, high long, negative_id long, score long")
    found = materialize(_ranked(found, ["anchor_id", "low", "high"], "negative_id", NEGATIVES), "negatives-found")
    out = spans.join(found, ["anchor_id", "low", "high"])
    discard(rows)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % {SEVENTH} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT * FROM n WHERE rank <= {NEGATIVES}"""
