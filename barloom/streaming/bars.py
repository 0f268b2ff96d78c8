"""Time bars of a stream of ticks: the streaming form of repeated downloads. Bins are final once the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bars import HOUR, _prices


def stream_time_bars(ticks: DataFrame, step: int = HOUR, late: str = "1 hour") -> DataFrame:
    """(market, ts_us, open, high, low, close, wavg, volume, value) of the bins with ticks; ticks later than ``late`` are dropped."""
    t = ticks.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)
    bins = F.window("ts", f"{step // 1000} milliseconds").alias("bin")
    out = t.groupBy("market", bins).agg(*_prices(), F.sum("volume").alias("volume"), F.sum("value").alias("value"))
    return out.select("market", F.unix_micros("bin.start").alias("ts_us"), "open", "high", "low", "close", F.try_divide("value", "volume").alias("wavg"), "volume", "value")
