"""Sequential bootstrap and bet sizes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import by_span, numbered

KEYS, TERMS = ("market",), 60


def indicator(bars: DataFrame, labels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, label_us, bar_no) for every bar of every label's span [ts_us, t1]: long, never a matrix."""
    placed = _places(bars, keys)
    first = labels.select(*keys, "ts_us", "t1").join(placed.withColumnRenamed("bar_no", "b0"), [*keys, "ts_us"])
    last = placed.select(*keys, F.col("ts_us").alias("t1"), F.col("bar_no").alias("b1"))
    return first.join(last, [*keys, "t1"]).select(*keys, F.col("ts_us").alias("label_us"), F.explode(F.sequence("b0", "b1")).alias("bar_no"))


def average_uniqueness(indicators: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, label_us, uniqueness): mean over the label's bars of one over the labels on that bar."""
    open_ = indicators.groupBy(*keys, "bar_no").agg(F.count("*").alias("n"))
    return indicators.join(open_, [*keys, "bar_no"]).groupBy(*keys, "label_us").agg(F.avg(1 / F.col("n")).alias("uniqueness"))


class _Chances:
    """Labels' chances as the leaves of a tree of sums: a change of some neighbours, and a draw, cost the tree's height."""

    def __init__(self, chance: np.ndarray) -> None:
        self.size = 1 << max(0, (len(chance) - 1).bit_length())
        self.tree = np.zeros(2 * self.size)
        self.set(0, chance)

    def set(self, first: int, chance: np.ndarray) -> None:
        low, high = self.size + first, self.size + first + len(chance) - 1
        self.tree[low : high + 1] = chance
        while low > 1:
            low, high = low >> 1, high >> 1
            self.tree[low : high + 1] = self.tree[2 * low : 2 * high + 2 : 2] + self.tree[2 * low + 1 : 2 * high + 3 : 2]

    def draw(self, share: float) -> int:
        """The first label up to which more than ``share`` of all chances lie."""
        at, left = 1, share * self.tree[1]
        while at < self.size:
            at *= 2
            if left >= self.tree[at]:
                left -= self.tree[at]
                at += 1
        return at - self.size


def _draws(low: np.ndarray, high: np.ndarray, n: int, rng: np.random.Generator) -> list[int]:
    """Labels [low, high], in order of low, drawn one by one. A draw raises the cover of its own bars, so only the labels that meet these are weighed anew, over the bars around."""
    cover, longest, out = np.zeros(int(high.max()) + 1), int((high - low).max()), []
    chances = _Chances(np.ones(len(low)))
    for _ in range(n):
        k = min(chances.draw(rng.random()), len(low) - 1)
        out.append(k)
        cover[low[k] : high[k] + 1] += 1
        a, b = np.searchsorted(low, low[k] - longest), np.searchsorted(low, high[k], "right")
        start, stop = low[a], high[a:b].max()
        upto = np.concatenate([[0.0], np.cumsum(1 / (cover[start : stop + 1] + 1))])
        chances.set(int(a), (upto[high[a:b] + 1 - start] - upto[low[a:b] - start]) / (high[a:b] - low[a:b] + 1))
    return out


def _places(bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, ts_us, bar_no), numbered from 0 by buckets and their counts."""
    return numbered(bars.select(*keys, "ts_us"), list(keys), ["ts_us"], by_span(), "bar_no")


def sequential_bootstrap(bars: DataFrame, labels: DataFrame, replicates: int, draws: int | None = None, seed: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, replicate, draw, label_us): labels drawn one by one, each with a chance proportional to its average uniqueness among those drawn.

    Draws depend on one another, so a replicate of a key is one task's work; replicates and keys run side by side. The task holds the spans (two numbers
    a label), how often each bar is covered and a tree of the labels' chances; a draw costs the tree's height and the bars around its own label, not all bars.
    """
    placed = _places(bars, keys)
    spans = labels.select(*keys, "ts_us", "t1").join(placed.withColumnRenamed("bar_no", "b0"), [*keys, "ts_us"])
    spans = spans.join(placed.select(*keys, F.col("ts_us").alias("t1"), F.col("bar_no").alias("b1")), [*keys, "t1"])
    spans = spans.select(*keys, F.col("ts_us").alias("label_us"), "b0", "b1", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label_us")
        low, high = (pdf[c].to_numpy(np.int64) - pdf["b0"].min() for c in ("b0", "b1"))
        drawn = _draws(low, high, draws or len(pdf), np.random.default_rng([seed, int(pdf["replicate"].iloc[0])]))
        return pdf.iloc[drawn][[*keys, "replicate", "label_us"]].assign(draw=range(len(drawn)))

    kinds = ", ".join(f"{k} {labels.schema[k].dataType.simpleString()}" for k in keys)
    return spans.groupBy(*keys, "replicate").applyInPandas(of, f"{kinds}, replicate int, label_us long, draw long")


def _normal(z: F.Column) -> F.Column:
    """The distribution function of the standard normal, which Spark lacks, in built-in expressions: below 3 the series z + z^3/3 + z^5/15 + ..., beyond a continued fraction."""
    x = F.abs(z)
    term, total = x, x
    step = lambda acc, k: F.struct((acc["term"] * x * x / (2 * k + 1)).alias("term"), (acc["total"] + acc["term"] * x * x / (2 * k + 1)).alias("total"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(term.alias("term"), total.alias("total")), step, lambda acc: acc["total"])
    far = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    beyond = F.when(x < 3, 0.5 - density * near).otherwise(F.try_divide(density, far))
    beyond = F.when(x == float("inf"), 0.0).otherwise(beyond)
    return F.when(z > 0, 1 - beyond).otherwise(beyond)


def sizes(predictions: DataFrame, n_classes: int) -> DataFrame:
    """``signal`` of rows (prob, pred[, side]): pred * (2 Phi(z) - 1) * side with z = (prob - 1/k) / sqrt(prob (1 - prob))."""
    z = F.try_divide(F.col("prob") - 1.0 / n_classes, F.sqrt(F.col("prob") * (1 - F.col("prob"))))
    z = F.when(F.col("prob") * (1 - F.col("prob")) == 0, F.when(F.col("prob") > 1.0 / n_classes, float("inf")).otherwise(float("-inf"))).otherwise(z)
    signal = F.col("pred") * (2 * _normal(z) - 1)
    return predictions.withColumn("signal", signal * F.col("side") if "side" in predictions.columns else signal)


def active_average(signals: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, signal) at every start and end: the mean of signals with ts_us <= t < t1 (no t1: still open), 0 if there are none. A sweep line."""
    marks = signals.select(*keys, F.explode(F.array(F.struct(F.col("ts_us").alias("at"), F.col("signal").alias("s"), F.lit(1).alias("d")), F.struct(F.col("t1").alias("at"), (-F.col("signal")).alias("s"), F.lit(-1).alias("d")))).alias("m"))
    marks = marks.where("m.at is not null").groupBy(*keys, F.col("m.at").alias("ts_us")).agg(F.sum("m.s").alias("s"), F.sum("m.d").alias("d"))
    upto = Window.partitionBy(*keys).orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("d").over(upto)
    return marks.select(*keys, "ts_us", F.when(n == 0, 0.0).otherwise(F.sum("s").over(upto) / n).alias("signal"))


def discrete(signals: DataFrame, step: float, floor: bool = False) -> DataFrame:
    """Signals rounded half to even to multiples of ``step``, at most 1 (and with ``floor`` at least -1)."""
    out = F.least(F.lit(1.0), F.bround(F.col("signal") / step) * step)
    return signals.withColumn("signal", F.greatest(F.lit(-1.0), out) if floor else out)


def bet_sizes(predictions: DataFrame, n_classes: int, step: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Average active signals of predictions (keys, ts_us, t1, prob, pred[, side]), in steps."""
    return discrete(active_average(sizes(predictions, n_classes), keys), step)
