"""Cleaning of bars: gap segments, warm-up, missing fields, repeated times, slices, and appending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("market",)


def segments(rows: DataFrame, gap_us: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``segment`` counts, from 0, the gaps longer than ``gap_us`` before each row."""
    w = Window.partitionBy(*keys).orderBy("ts_us")
    far = (F.col("ts_us") - F.lag("ts_us").over(w) > gap_us).cast("int")
    return rows.withColumn("far", F.coalesce(far, F.lit(0))).withColumn("segment", F.sum("far").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("far")


def trim(bars: DataFrame, first: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Without the first rows of each key."""
    return bars.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("ts_us"))).where(F.col("rn") > first).drop("rn")


def complete(bars: DataFrame) -> DataFrame:
    return bars.dropna()


def keep_last(rows: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last row of each time, by ``order``; an aggregation, so copies are folded before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "ts_us")]
    picked = rows.groupBy(*keys, "ts_us").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(*keys, "ts_us", "r.*").select(rows.columns)


def between(rows: DataFrame, first_us: int | None = None, last_us: int | None = None) -> DataFrame:
    """Rows of a closed range of times."""
    for bound, test in ((first_us, lambda c, x: c >= x), (last_us, lambda c, x: c <= x)):
        rows = rows if bound is None else rows.where(test(F.col("ts_us"), bound))
    return rows


def append(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
