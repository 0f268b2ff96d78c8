"""Sample weights of labels by concurrency, return and age. Spans are closed, [ts_us, t1]; a missing t1 runs to the last bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import DAY

KEYS = ("market",)


def concurrency(bars: DataFrame, labels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, n) for the bars from the first start to the last end: how many labels are open. A sweep: +1 at starts, -1 after ends."""
    last = bars.groupBy(*keys).agg(F.max("ts_us").alias("last_us"))
    spans = labels.join(last, list(keys)).select(*keys, "ts_us", F.coalesce("t1", "last_us").alias("end_us"))
    marks = spans.select(*keys, F.explode(F.array(F.struct(F.col("ts_us").alias("at"), F.lit(1).alias("d"), F.lit(0).alias("late")), F.struct(F.col("end_us").alias("at"), F.lit(-1).alias("d"), F.lit(2).alias("late")))).alias("m"))
    marks = marks.groupBy(*keys, "m.at", "m.late").agg(F.sum("m.d").alias("d"))
    rows = bars.select(*keys, F.col("ts_us").alias("at"), F.lit(1).alias("late"), F.lit(0).cast("long").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    bounds = spans.groupBy(*keys).agg(F.min("ts_us").alias("low"), F.max("end_us").alias("high"))
    out = rows.unionByName(marks.select(rows.columns)).withColumn("n", F.sum("d").over(w)).where("late = 1").join(bounds, list(keys)).where("at between low and high")
    return out.select(*keys, F.col("at").alias("ts_us"), "n")


def span_weights(bars: DataFrame, labels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts_us, t1, tw, w, ret_sum): mean of 1/n over the span; size of the sum of log-returns / n; sum of log-returns. Running sums and two lookups."""
    w = Window.partitionBy(*keys).orderBy("ts_us")
    rows = bars.select(*keys, "ts_us", F.log(F.try_divide("close", F.lag("close").over(w))).alias("r")).join(concurrency(bars, labels, keys), [*keys, "ts_us"])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce("r", F.lit(0.0))
    part = F.try_divide(F.lit(1.0), "n")
    sums = rows.select(
        *keys, "ts_us", part.alias("u"), F.coalesce(r * part, F.lit(0.0)).alias("a"), r.alias("b"), F.sum(part).over(upto).alias("su"),
        F.sum(F.coalesce(r * part, F.lit(0.0))).over(upto).alias("sa"), F.sum(r).over(upto).alias("sb"), F.row_number().over(w).alias("rn"),
    )
    start, end = sums.alias("s"), sums.select(*keys, F.col("ts_us").alias("t1"), F.col("su").alias("eu"), F.col("sa").alias("ea"), F.col("sb").alias("eb"), F.col("rn").alias("en"))
    out = labels.select(*keys, "ts_us", "t1").join(start, [*keys, "ts_us"]).join(end, [*keys, "t1"], "left")
    n = F.col("en") - F.col("rn") + 1
    return out.select(*keys, "ts_us", "t1", ((F.col("eu") - F.col("su") + F.col("u")) / n).alias("tw"), F.abs(F.col("ea") - F.col("sa") + F.col("a")).alias("w"), (F.col("eb") - F.col("sb") + F.col("b")).alias("ret_sum"))


def normalise(weights: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """w scaled to sum to the number of labels of each key."""
    m = Window.partitionBy(*keys)
    return weights.withColumn("w", F.try_divide(F.col("w") * F.count("w").over(m), F.sum("w").over(m)))


def time_decay(weights: DataFrame, last: float | F.Column = 1.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``decay``: linear in the running uniqueness, newest 1 and oldest ``last``; a negative ``last`` zeroes the oldest part."""
    m = Window.partitionBy(*keys)
    upto, total = F.sum("tw").over(m.orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0)), F.sum("tw").over(m)
    last = last if isinstance(last, F.Column) else F.lit(float(last))
    slope = F.when(last >= 0, F.try_divide(1 - last, total)).otherwise(F.try_divide(F.lit(1.0), (last + 1) * total))
    return weights.withColumn("decay", F.greatest(F.lit(0.0), 1 - slope * total + slope * upto))


def aged(weights: DataFrame, percent: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``decay`` losing ``percent`` a year over the whole days between the first and last label, and dw = w * decay."""
    m = Window.partitionBy(*keys)
    days = F.floor((F.max("ts_us").over(m) - F.min("ts_us").over(m)) / DAY)
    rows = weights.withColumn("last", 1 - (percent / 100) * days / 365)
    return time_decay(rows, F.col("last"), keys).drop("last").withColumn("dw", F.col("w") * F.col("decay"))


def mean_uniqueness(weights: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return weights.groupBy(*keys).agg(F.avg("tw").alias("tw"))
