"""Bars from ticks: by time, count, volume and value, with constant or rolling thresholds.

``edges="reference"`` keeps the edge habits of the analysed jobs: tick bars leave the last tick of a bar out of high, low and sums, and the last
full bar is not given; volume and value bars open with the tick that closed the bar before, which the counted sum does not count again.
``edges="full"`` counts every tick once. ``keys`` may add a gap segment to the market.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered, relay

HOUR, MINUTE, DAY = 3_600_000_000, 60_000_000, 86_400_000_000
KEYS = ("market",)
COLUMNS = ("open", "high", "low", "close", "wavg", "volume", "value")


def _prices() -> list[F.Column]:
    at = F.struct("ts_us", "seq")
    return [F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close")]


def _floor(c: F.Column, step: int) -> F.Column:
    return c - F.pmod(c, F.lit(step))


def spine(bounds: DataFrame, step: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every multiple of ``step`` from ``first`` to ``last`` of each key."""
    return bounds.select(*keys, F.explode(F.sequence("first", "last", F.lit(step).cast("long"))).alias("ts_us"))


def time_bars(ticks: DataFrame, step: int = HOUR, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Left-closed calendar bins; empty bins are kept with volume and value 0 and no prices. Needs no order: partial sums before the shuffle."""
    made = ticks.withColumn("bin", _floor(F.col("ts_us"), step))
    made = made.groupBy(*keys, "bin").agg(*_prices(), F.sum("volume").alias("volume"), F.sum("value").alias("value"), F.count("*").alias("n")).withColumnRenamed("bin", "ts_us")
    every = spine(made.groupBy(*keys).agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last")), step, keys)
    out = every.join(made, [*keys, "ts_us"], "left")
    zero = F.lit(0.0)
    return out.select(*keys, "ts_us", "open", "high", "low", "close", F.try_divide("value", "volume").alias("wavg"), F.coalesce("volume", zero).alias("volume"), F.coalesce("value", zero).alias("value"))


def tick_bars(ticks: DataFrame, every: int, edges: str = "reference", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every ``every`` trades make a bar; its time and close are those of the last. A running number within time buckets, then bucket offsets,
    so that no task must order a whole market."""
    t = ticks.withColumn("bucket", _floor(F.col("ts_us"), HOUR))
    counts = t.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    counts = counts.select(*keys, "bucket", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(*keys)).alias("total"))
    inner = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("ts_us", "seq")) - 1
    t = t.withColumn("inner", inner).join(counts, [*keys, "bucket"]).withColumn("rn", F.col("before") + F.col("inner"))
    t = t.withColumn("bar_no", F.floor(F.col("rn") / every)).withColumn("bars", F.floor(F.col("total") / every))
    own = (F.col("rn") % every < every - 1) if edges == "reference" else F.lit(True)
    t = t.where(F.col("bar_no") < (F.col("bars") - 1 if edges == "reference" else F.col("bars")))
    at = F.struct("ts_us", "seq")
    only = lambda c: F.when(own, F.col(c))
    out = t.groupBy(*keys, "bar_no").agg(
        F.max("ts_us").alias("ts_us"), F.min_by("price", at).alias("open"), F.max(only("price")).alias("high"), F.min(only("price")).alias("low"),
        F.max_by("price", at).alias("close"), F.coalesce(F.sum(only("volume")), F.lit(0.0)).alias("volume"), F.coalesce(F.sum(only("value")), F.lit(0.0)).alias("value"),
    )
    return out.withColumn("wavg", F.try_divide("value", "volume")).select(*keys, "bar_no", "ts_us", *COLUMNS)


class _Closes:
    """Where bars close in a chunk of ticks: a bar that starts at tick k closes at the first i with limit_i - total_i < -total_k, found by halving over minima of powers of two."""

    def __init__(self, amounts: np.ndarray, limits: np.ndarray) -> None:
        self.n = len(amounts)
        self.total = np.concatenate([[0.0], np.cumsum(amounts)])
        self.room = np.append(np.where(np.isnan(limits), np.inf, limits) - self.total[1:], np.inf)
        self.least = [self.room]
        while (1 << len(self.least)) <= self.n:
            m = self.least[-1]
            self.least.append(np.minimum(m, m[np.minimum(np.arange(self.n + 1) + (1 << len(self.least) - 1), self.n)]))
        self.next = self.first(np.arange(self.n + 1), -self.total)

    def first(self, start: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The first tick from ``start`` on whose room is below; n if there is none."""
        at = start.copy()
        for p in range(len(self.least) - 1, -1, -1):
            at = np.where(self.least[p][at] >= below, np.minimum(at + (1 << p), self.n), at)
        return at

    def ends(self, held: float) -> list[int]:
        """All closes, given the sum that the bar before the chunk holds."""
        i, out = int(self.first(np.zeros(1, np.int64), np.array([held]))[0]), []
        while i < self.n:
            out.append(i)
            i = int(self.next[i + 1])
        return out

    def transducer(self) -> dict:
        """What comes of any held sum: the first piece whose bound is below it says how many bars close and what is held then; if none is, nothing closes.

        Starts that close at different first ticks soon share a close, from which on they are one path: paths are joined by doubling their steps, and pieces with one end are merged.
        """
        goes = np.where(self.next < self.n, self.next + 1, np.arange(self.n + 1))
        bars = (self.next < self.n).astype(np.int64)
        while (goes[goes] != goes).any():
            bars, goes = bars + bars[goes], goes[goes]
        room = self.room[:-1]
        record = np.flatnonzero(room < np.concatenate([[np.inf], np.minimum.accumulate(room)[:-1]]))
        record = record[: int(np.searchsorted(-room[record], 0, "right")) + 1]  # a held sum is not negative
        end, count = goes[record + 1], bars[record + 1] + 1
        last = np.flatnonzero(np.append((end[1:] != end[:-1]) | (count[1:] != count[:-1]), True)) if len(record) else record
        return {"bounds": room[record[last]], "held": self.total[-1] - self.total[end[last]], "bars": count[last], "total": float(self.total[-1])}


def _numbered(ticks: DataFrame, counted: str, limit: F.Column, keys: tuple[str, ...], chunk: int | None = None) -> DataFrame:
    """Ticks with ``bar_no`` and whether they close their bar. A relay: each chunk gives its transducer, which takes the bar's number and sum so far from chunk to chunk."""
    columns = ["ts_us", "seq", "price", "volume", "value"]
    rows = ticks.select(*keys, *columns, limit.alias("limit"), F.coalesce(F.col(counted), F.lit(0.0)).alias("amount"))
    closes = lambda pdf: _Closes(pdf["amount"].to_numpy(float), pdf["limit"].to_numpy(float))

    def carry(state, row):
        number, held = state or (0, 0.0)
        k = int(np.searchsorted(-np.asarray(row.bounds), -held, "right"))
        return (number + int(row.bars[k]), float(row.held[k])) if k < len(row.bounds) else (number, held + row.total)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        shut = np.zeros(len(pdf), bool)
        shut[closes(pdf).ends(float(pdf["before_sum"].iloc[0]))] = True
        return pdf[[*keys, *columns]].assign(bar_no=pdf["before_no"].to_numpy() + np.cumsum(shut) - shut, closes=shut)

    kinds = ", ".join(f"{k} {ticks.schema[k].dataType.simpleString()}" for k in keys)
    return relay(
        rows, list(keys), ["ts_us", "seq"], _floor(F.col("ts_us"), HOUR), (lambda pdf: closes(pdf).transducer(), "bounds array<double>, held array<double>, bars array<long>, total double"),
        carry, (lambda state: list(state or (0, 0.0)), "before_no long, before_sum double"),
        (final, f"{kinds}, ts_us long, seq long, price double, volume double, value double, bar_no long, closes boolean"), chunk,
    )


def _threshold_bars(ticks: DataFrame, counted: str, limit: F.Column, edges: str, keys: tuple[str, ...], value_as_volume: bool) -> DataFrame:
    t = _numbered(ticks, counted, limit, keys)
    other = "value" if counted == "volume" or value_as_volume else "volume"
    t = t.withColumn("carry", F.lit(False))
    if edges == "reference":
        t = t.unionByName(t.where("closes").withColumn("bar_no", F.col("bar_no") + 1).withColumn("closes", F.lit(False)).withColumn("carry", F.lit(True)))
    at = F.struct("ts_us", "seq")
    out = t.groupBy(*keys, "bar_no").agg(
        F.max("ts_us").alias("ts_us"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(F.when(~F.col("carry"), F.col(counted))).alias("counted"), F.sum(other).alias("other"), F.max("closes").alias("closed"),
    ).where("closed")
    names = ("counted", "other") if counted == "volume" else ("other", "counted")
    out = out.withColumnRenamed(names[0], "volume").withColumnRenamed(names[1], "value")
    return out.withColumn("wavg", F.try_divide("value", "volume")).select(*keys, "bar_no", "ts_us", *COLUMNS)


def volume_bars(ticks: DataFrame, limit: float, edges: str = "reference", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A bar closes at the first tick with which the volume since the last close exceeds ``limit``; an open last bar is not given."""
    return _threshold_bars(ticks, "volume", F.lit(float(limit)), edges, keys, False)


def value_bars(ticks: DataFrame, limit: float, edges: str = "reference", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same by traded value; in reference mode the volume column sums the value too."""
    return _threshold_bars(ticks, "value", F.lit(float(limit)), edges, keys, edges == "reference")


def rolling_limits(ticks: DataFrame, counted: str, window: int = 0, grain: int = HOUR, lookahead: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Ticks with ``limit``: the mean of the grain bars' sums, expanding (window 0) or of ``window`` bars, without the first grain bar.

    The lookup moves on by one mean a tick at most, so after a gap it catches up: at tick i it is min(i + 1, i + min over j <= i of (a_j - j)), where a_j is
    the last mean before tick j. The mean at T covers [T, T + grain); ``lookahead=False`` takes the mean before it instead.
    """
    grains = time_bars(ticks, grain, keys).select(*keys, "ts_us", F.col(counted).alias("x"))
    w = Window.partitionBy(*keys).orderBy("ts_us")
    grains = grains.withColumn("rn", F.row_number().over(w)).where("rn > 1")
    frame = w.rowsBetween(Window.unboundedPreceding if not window else 1 - window, 0)
    grains = grains.withColumn("mean", F.avg("x").over(frame)).withColumn("have", F.count("x").over(frame))
    grains = grains.where(F.col("have") >= max(1, window)).withColumn("k", F.row_number().over(w) - 1)
    if not lookahead:
        grains = grains.withColumn("mean", F.coalesce(F.lag("mean").over(w), F.col("mean")))
    # bars stand at every grain from the first on, so the last one before a tick follows from the times; a mean counts for later ticks only
    edge = grains.groupBy(*keys).agg(F.min("ts_us").alias("first"), F.max("k").alias("last"))
    t = numbered(ticks.join(edge, list(keys), "left"), list(keys), ["ts_us", "seq"], _floor(F.col("ts_us"), HOUR), "i")
    asof = F.greatest(F.lit(0), F.least(F.col("last"), F.floor((F.col("ts_us") - 1 - F.col("first")) / grain)))
    t = t.withColumn("lead", F.coalesce(asof, F.lit(0)) - F.col("i")).withColumn("bucket", _floor(F.col("ts_us"), HOUR))
    # the least lead so far: within the hour, and of the hours before
    hours = t.groupBy(*keys, "bucket").agg(F.min("lead").alias("least"))
    hours = hours.select(*keys, "bucket", F.min("least").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = F.min("lead").over(Window.partitionBy(*keys, "bucket").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("within", within).join(hours, [*keys, "bucket"])
    step = F.least(F.col("i") + 1, F.col("i") + F.least("within", "before"))
    t = t.withColumn("k", step.cast("int")).drop("first", "last", "lead", "bucket", "within", "before", "i")
    return t.join(grains.select(*keys, "k", F.col("mean").alias("limit")), [*keys, "k"], "left").drop("k")


def rolling_volume_bars(ticks: DataFrame, window: int = 0, grain: int = HOUR, edges: str = "reference", lookahead: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return _threshold_bars(rolling_limits(ticks, "volume", window, grain, lookahead, keys), "volume", F.col("limit"), edges, keys, False)


def rolling_value_bars(ticks: DataFrame, window: int = 0, grain: int = HOUR, edges: str = "reference", lookahead: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return _threshold_bars(rolling_limits(ticks, "value", window, grain, lookahead, keys), "value", F.col("limit"), edges, keys, False)


def ohlc(ticks: DataFrame, minutes: int, shift: int = 0, keys: tuple[str, ...] = KEYS, zone: str | None = None) -> DataFrame:
    """Minute bars with the last close filling empty ones, vwap (close where there is no volume) and the number of trades.

    ``zone`` bins by the local time of a time zone, daylight saving included: where clocks go back, the hour that occurs twice makes one row of bins, and
    ``shift`` microseconds are added before binning, for bins at a constant offset.
    """
    micros = lambda f, c: F.unix_micros(f(F.timestamp_micros(c), F.lit(zone)))
    local = lambda c: (micros(F.from_utc_timestamp, c) if zone else c) + shift
    moved = ticks.withColumn("ts_us", local(F.col("ts_us")))
    bars = time_bars(moved, minutes * MINUTE, keys)
    n = moved.withColumn("ts_us", _floor(F.col("ts_us"), minutes * MINUTE)).groupBy(*keys, "ts_us").agg(F.count("*").alias("trades"))
    last = F.last("close", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0))
    bars = bars.join(n, [*keys, "ts_us"], "left").withColumn("close", last)
    filled = [F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")]
    back = F.col("ts_us") - shift
    at = micros(F.to_utc_timestamp, back) if zone else back
    return bars.select(*keys, at.alias("ts_us"), *filled, "close", "volume", F.coalesce("wavg", "close").alias("vwap"), F.coalesce("trades", F.lit(0)).alias("trades"))


def per_day(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """How many bars have each column, by day; days without bars count 0."""
    day = _floor(F.col("ts_us"), DAY)
    made = bars.groupBy(*keys, day.alias("day")).agg(*(F.count(c).alias(c) for c in COLUMNS)).withColumnRenamed("day", "ts_us")
    every = spine(made.groupBy(*keys).agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last")), DAY, keys)
    return every.join(made, [*keys, "ts_us"], "left").fillna(0, list(COLUMNS))


METHODS = {
    "tb": time_bars, "time": time_bars, "tcb": tick_bars, "tick": tick_bars, "cvolb": volume_bars, "volume": volume_bars, "ceurob": value_bars, "value": value_bars,
    "rvolb": rolling_volume_bars, "rolling_volume": rolling_volume_bars, "reurob": rolling_value_bars, "rolling_value": rolling_value_bars,
}


def sample(ticks: DataFrame, method: str, *args, **options) -> DataFrame:
    """Bars by the method of that name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; one of {', '.join(METHODS)}")
    return METHODS[method](ticks, *args, **options)
